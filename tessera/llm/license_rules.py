"""Ordered licence signatures.

``NAMES`` are hand-written patterns of licence names, ``LINKS`` of their pages and
``PHRASES`` of sentences that only one licence has.  A name gives three rules: an
SPDX tag, a grant ("licensed under ...") and the bare name, in falling priority.
Every rule has keywords, at least one of which any match of it must contain; they
are read off its pattern, so none of its alternatives can be left out.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser

# licence | pattern of the name
_NAMES = r"""
GPL-3.0-or-later | (?:GNU\s+General\s+Public\s+Licen[cs]e|GNU\s+GPL|GPL),?\s*(?:v(?:ersion)?\.?\s*)?3(?:\.0)?\s*(?:,?\s*or\s*(?:\(?at\s+your\s+option\)?\s*)?(?:any\s+)?later(?:\s+version)?|\+)
GPL-3.0-only | (?:GNU\s+General\s+Public\s+Licen[cs]e|GNU\s+GPL|GPL)[,-]?\s*(?:\(GPL\)\s*)?(?:v(?:ersion)?\.?\s*)?3(?:\.0)?\b(?!\.[1-9])
GPL-2.0-or-later | (?:GNU\s+General\s+Public\s+Licen[cs]e|GNU\s+GPL|GPL),?\s*(?:v(?:ersion)?\.?\s*)?2(?:\.0)?\s*(?:,?\s*or\s*(?:\(?at\s+your\s+option\)?\s*)?(?:any\s+)?later(?:\s+version)?|\+)
GPL-2.0-only | (?:GNU\s+General\s+Public\s+Licen[cs]e|GNU\s+GPL|GPL)[,-]?\s*(?:\(GPL\)\s*)?(?:v(?:ersion)?\.?\s*)?2(?:\.0)?\b(?!\.[1-9])
GPL-1.0-or-later | GNU\s+General\s+Public\s+Licen[cs]e(?:,?\s*v(?:ersion)?\.?\s*1(?:\.0)?)?
LGPL-3.0-or-later | (?:GNU\s+Lesser\s+General\s+Public\s+Licen[cs]e|LGPL),?\s*(?:v(?:ersion)?\.?\s*)?3(?:\.0)?\s*(?:,?\s*or\s*(?:any\s+)?later|\+)
LGPL-3.0-only | (?:GNU\s+Lesser\s+General\s+Public\s+Licen[cs]e|LGPL)[,-]?\s*(?:v(?:ersion)?\.?\s*)?3(?:\.0)?\b
LGPL-2.1-or-later | (?:GNU\s+Lesser\s+General\s+Public\s+Licen[cs]e|LGPL),?\s*(?:v(?:ersion)?\.?\s*)?2\.1\s*(?:,?\s*or\s*(?:any\s+)?later|\+)
LGPL-2.1-only | (?:GNU\s+Lesser\s+General\s+Public\s+Licen[cs]e|LGPL)[,-]?\s*(?:v(?:ersion)?\.?\s*)?2\.1\b
LGPL-2.0-only | (?:GNU\s+Library\s+General\s+Public\s+Licen[cs]e|LGPL)[,-]?\s*(?:v(?:ersion)?\.?\s*)?2(?:\.0)?\b(?!\.1)
LGPL-2.0-or-later | GNU\s+(?:Lesser|Library)\s+General\s+Public\s+Licen[cs]e
AGPL-3.0-or-later | (?:GNU\s+Affero\s+General\s+Public\s+Licen[cs]e|AGPL),?\s*(?:v(?:ersion)?\.?\s*)?3(?:\.0)?\s*(?:,?\s*or\s*(?:any\s+)?later|\+)
AGPL-3.0-only | (?:GNU\s+Affero\s+General\s+Public\s+Licen[cs]e|AGPL)(?:[,-]?\s*(?:v(?:ersion)?\.?\s*)?3(?:\.0)?\b)?
AGPL-1.0-only | Affero\s+General\s+Public\s+Licen[cs]e,?\s*v(?:ersion)?\.?\s*1
GFDL-1.3-only | (?:GNU\s+Free\s+Documentation\s+Licen[cs]e|GFDL)[,-]?\s*(?:v(?:ersion)?\.?\s*)?1\.3
GFDL-1.2-only | (?:GNU\s+Free\s+Documentation\s+Licen[cs]e|GFDL)[,-]?\s*(?:v(?:ersion)?\.?\s*)?1\.2
GFDL-1.1-or-later | GNU\s+Free\s+Documentation\s+Licen[cs]e|\bGFDL\b
Apache-2.0 | Apache\s*(?:Software\s+)?Licen[cs]e[,-]?\s*(?:\(?v(?:ersion)?\.?\s*)?2(?:\.0)?\b|Apache[\s-]2(?:\.0)?(?:\s+Licen[cs]e)?
Apache-1.1 | Apache\s+(?:Software\s+)?Licen[cs]e,?\s*(?:v(?:ersion)?\.?\s*)?1\.1
Apache-1.0 | Apache\s+(?:Software\s+)?Licen[cs]e,?\s*(?:v(?:ersion)?\.?\s*)?1\.0
MIT | (?:The\s+)?\bMIT(?:/X11)?(?:\s+open\s+source)?\s+Licen[cs]e|\bExpat\s+Licen[cs]e|\bMIT-style\s+licen[cs]e
MIT-0 | MIT\s+No\s+Attribution(?:\s+Licen[cs]e)?|\bMIT-0\b
X11 | \bX11\s+Licen[cs]e|\bX\s+Consortium\s+Licen[cs]e
BSD-3-Clause | (?:New|Modified|Revised|3-Clause|Three[\s-]clause)\s+BSD(?:\s+Licen[cs]e)?|BSD[\s-]3[\s-]Clause(?:\s+(?:"New"\s+or\s+"Revised"\s+)?Licen[cs]e)?
BSD-2-Clause | (?:Simplified|2-Clause|Two[\s-]clause|FreeBSD)\s+(?:BSD\s+)?Licen[cs]e|BSD[\s-]2[\s-]Clause(?:\s+(?:"Simplified"\s+)?Licen[cs]e)?
BSD-4-Clause | (?:Original|Old|4-Clause)\s+BSD(?:\s+Licen[cs]e)?|BSD[\s-]4[\s-]Clause
BSD-1-Clause | BSD[\s-]1[\s-]Clause(?:\s+Licen[cs]e)?
0BSD | (?:BSD\s+)?Zero[\s-]Clause\s+BSD(?:\s+Licen[cs]e)?|\b0BSD\b
BSD-Protection | BSD\s+Protection\s+Licen[cs]e
BSD-unspecified | \bBSD(?:-style)?\s+licen[cs]e
ISC | \bISC\s+Licen[cs]e
MPL-2.0 | (?:Mozilla\s+Public\s+Licen[cs]e|MPL)[,-]?\s*(?:\(MPL\)\s*)?(?:v(?:ersion)?\.?\s*)?2(?:\.0)?\b
MPL-1.1 | (?:Mozilla\s+Public\s+Licen[cs]e|MPL)[,-]?\s*(?:v(?:ersion)?\.?\s*)?1\.1\b
MPL-1.0 | (?:Mozilla\s+Public\s+Licen[cs]e|MPL)[,-]?\s*(?:v(?:ersion)?\.?\s*)?1\.0\b
MPL-unspecified | Mozilla\s+Public\s+Licen[cs]e
EPL-2.0 | (?:Eclipse\s+Public\s+Licen[cs]e|\bEPL)\s*[,-]?\s*(?:v(?:ersion)?\.?\s*)?2(?:\.0)?\b
EPL-1.0 | (?:Eclipse\s+Public\s+Licen[cs]e|\bEPL)\s*[,-]?\s*(?:v(?:ersion)?\.?\s*)?1(?:\.0)?\b
EDL-1.0 | Eclipse\s+Distribution\s+Licen[cs]e
CDDL-1.1 | (?:Common\s+Development\s+and\s+Distribution\s+Licen[cs]e|CDDL)\s*[,-]?\s*(?:\(CDDL\)\s*)?(?:v(?:ersion)?\.?\s*)?1\.1
CDDL-1.0 | (?:Common\s+Development\s+and\s+Distribution\s+Licen[cs]e|\bCDDL\b)(?:\s*[,-]?\s*(?:\(CDDL\)\s*)?(?:v(?:ersion)?\.?\s*)?1\.0)?
CPL-1.0 | Common\s+Public\s+Licen[cs]e
CPAL-1.0 | Common\s+Public\s+Attribution\s+Licen[cs]e
IPL-1.0 | IBM\s+Public\s+Licen[cs]e
Artistic-2.0 | Artistic\s+Licen[cs]e,?\s*(?:v(?:ersion)?\.?\s*)?2(?:\.0)?
Artistic-1.0 | Artistic\s+Licen[cs]e(?:,?\s*(?:v(?:ersion)?\.?\s*)?1(?:\.0)?)?
Zlib | \bzlib(?:/libpng)?\s+Licen[cs]e
Libpng | \blibpng\s+Licen[cs]e
BSL-1.0 | Boost\s+Software\s+Licen[cs]e(?:[\s,-]*(?:v(?:ersion)?\.?\s*)?1\.0)?
BUSL-1.1 | Business\s+Source\s+Licen[cs]e(?:[\s,-]*(?:v(?:ersion)?\.?\s*)?1\.1)?
SSPL-1.0 | Server\s+Side\s+Public\s+Licen[cs]e|\bSSPL\b(?:[\s-]*(?:v(?:ersion)?\.?\s*)?1(?:\.0)?)?
Elastic-2.0 | Elastic\s+Licen[cs]e(?:[\s,-]*(?:v(?:ersion)?\.?\s*)?2(?:\.0)?)?
Unlicense | \bThe\s+Unlicense\b|\bUnlicense\b
WTFPL | \bWTFPL\b|Do\s+What\s+The\s+Fuck\s+You\s+Want\s+To\s+Public\s+Licen[cs]e
CC0-1.0 | \bCC0(?:\s+1\.0)?(?:\s+Universal)?(?:\s+Public\s+Domain\s+Dedication)?|Creative\s+Commons\s+Zero
CC-BY-4.0 | \bCC[\s-]BY[\s-]4\.0|Creative\s+Commons\s+Attribution\s+4\.0(?:\s+International)?
CC-BY-3.0 | \bCC[\s-]BY[\s-]3\.0|Creative\s+Commons\s+Attribution\s+3\.0(?:\s+Unported)?
CC-BY-2.5 | \bCC[\s-]BY[\s-]2\.5|Creative\s+Commons\s+Attribution\s+2\.5
CC-BY-2.0 | \bCC[\s-]BY[\s-]2\.0|Creative\s+Commons\s+Attribution\s+2\.0
CC-BY-SA-4.0 | \bCC[\s-]BY-SA[\s-]4\.0|Creative\s+Commons\s+Attribution[\s-]+Share\s?Alike\s+4\.0(?:\s+International)?
CC-BY-SA-3.0 | \bCC[\s-]BY-SA[\s-]3\.0|Creative\s+Commons\s+Attribution[\s-]+Share\s?Alike\s+3\.0(?:\s+Unported)?
CC-BY-SA-2.5 | \bCC[\s-]BY-SA[\s-]2\.5|Creative\s+Commons\s+Attribution[\s-]+Share\s?Alike\s+2\.5
CC-BY-SA-2.0 | \bCC[\s-]BY-SA[\s-]2\.0|Creative\s+Commons\s+Attribution[\s-]+Share\s?Alike\s+2\.0
CC-BY-NC-4.0 | \bCC[\s-]BY-NC[\s-]4\.0|Creative\s+Commons\s+Attribution[\s-]+Non-?Commercial\s+4\.0(?:\s+International)?
CC-BY-NC-3.0 | \bCC[\s-]BY-NC[\s-]3\.0|Creative\s+Commons\s+Attribution[\s-]+Non-?Commercial\s+3\.0
CC-BY-NC-2.5 | \bCC[\s-]BY-NC[\s-]2\.5|Creative\s+Commons\s+Attribution[\s-]+Non-?Commercial\s+2\.5
CC-BY-NC-2.0 | \bCC[\s-]BY-NC[\s-]2\.0|Creative\s+Commons\s+Attribution[\s-]+Non-?Commercial\s+2\.0
CC-BY-NC-SA-4.0 | \bCC[\s-]BY-NC-SA[\s-]4\.0
CC-BY-NC-SA-3.0 | \bCC[\s-]BY-NC-SA[\s-]3\.0
CC-BY-NC-SA-2.5 | \bCC[\s-]BY-NC-SA[\s-]2\.5
CC-BY-NC-SA-2.0 | \bCC[\s-]BY-NC-SA[\s-]2\.0
CC-BY-ND-4.0 | \bCC[\s-]BY-ND[\s-]4\.0|Creative\s+Commons\s+Attribution[\s-]+No\s?Deriv(?:ative)?s\s+4\.0
CC-BY-ND-3.0 | \bCC[\s-]BY-ND[\s-]3\.0|Creative\s+Commons\s+Attribution[\s-]+No\s?Deriv(?:ative)?s\s+3\.0
CC-BY-NC-ND-4.0 | \bCC[\s-]BY-NC-ND[\s-]4\.0
CC-BY-NC-ND-3.0 | \bCC[\s-]BY-NC-ND[\s-]3\.0
CC-BY-NC-ND-2.5 | \bCC[\s-]BY-NC-ND[\s-]2\.5
CC-unspecified | Creative\s+Commons(?:\s+Licen[cs]e)?
CC-PDDC | Public\s+Domain\s+(?:Mark|Dedication)(?:\s+1\.0)?
ODbL-1.0 | Open\s+(?:Data\s+Commons\s+Open\s+)?Database\s+Licen[cs]e|\bODbL\b
ODC-By-1.0 | Open\s+Data\s+Commons\s+Attribution\s+Licen[cs]e|\bODC-By\b
PDDL-1.0 | Open\s+Data\s+Commons\s+Public\s+Domain\s+Dedication\s+and\s+Licen[cs]e|\bPDDL\b
OGL-UK-3.0 | Open\s+Government\s+Licen[cs]e(?:\s*v?3(?:\.0)?)?
DL-DE-BY-2.0 | Datenlizenz\s+Deutschland\s+(?:-\s+)?Namensnennung(?:\s+(?:-\s+)?(?:Version\s+)?2\.0)?
etalab-2.0 | Licence\s+Ouverte(?:\s*/\s*Open\s+Licen[cs]e)?(?:\s*(?:version\s*)?2\.0)?|\betalab[\s-]2\.0
CDLA-Permissive-2.0 | Community\s+Data\s+Licen[cs]e\s+Agreement\s*[–-]?\s*Permissive(?:[\s,-]*(?:v(?:ersion)?\.?\s*)?2\.0)?|\bCDLA-Permissive-2\.0
CDLA-Sharing-1.0 | Community\s+Data\s+Licen[cs]e\s+Agreement\s*[–-]?\s*Sharing|\bCDLA-Sharing-1\.0
EUPL-1.2 | (?:European\s+Union\s+Public\s+Licen[cs]e|\bEUPL\b)(?:[\s,-]*(?:v(?:ersion)?\.?\s*)?1\.2)?
EUPL-1.1 | (?:European\s+Union\s+Public\s+Licen[cs]e|\bEUPL)[\s,-]*(?:v(?:ersion)?\.?\s*)?1\.1
CECILL-2.1 | \bCeCILL(?:\s+Free\s+Software\s+Licen[cs]e)?(?:[\s,-]*(?:v(?:ersion)?\.?\s*)?2\.1)?
CECILL-B | \bCeCILL-B\b
CECILL-C | \bCeCILL-C\b
OFL-1.1 | (?:SIL\s+)?Open\s+Font\s+Licen[cs]e(?:[\s,-]*(?:v(?:ersion)?\.?\s*)?1\.1)?
OFL-1.0 | SIL\s+Open\s+Font\s+Licen[cs]e[\s,-]*(?:v(?:ersion)?\.?\s*)?1\.0
UPL-1.0 | Universal\s+Permissive\s+Licen[cs]e
NCSA | University\s+of\s+Illinois(?:/NCSA)?\s+Open\s+Source\s+Licen[cs]e|NCSA\s+Open\s+Source\s+Licen[cs]e
PostgreSQL | PostgreSQL\s+Licen[cs]e
PSF-2.0 | Python\s+Software\s+Foundation\s+Licen[cs]e(?:[\s,-]*(?:v(?:ersion)?\.?\s*)?2)?|\bPSF\s+Licen[cs]e
Python-2.0 | \bPython\s+Licen[cs]e(?:[\s,-]*(?:v(?:ersion)?\.?\s*)?2(?:\.0)?)?
PHP-3.01 | \bPHP\s+Licen[cs]e(?:[\s,-]*(?:v(?:ersion)?\.?\s*)?3\.01)?
Ruby | \bRuby\s+Licen[cs]e
OpenSSL | \bOpenSSL\s+Licen[cs]e
curl | \bcurl\s+Licen[cs]e
Vim | \bVim\s+Licen[cs]e
W3C | W3C\s+Software\s+(?:Notice\s+and\s+)?Licen[cs]e
AFL-3.0 | Academic\s+Free\s+Licen[cs]e(?:[\s,-]*(?:v(?:ersion)?\.?\s*)?3(?:\.0)?)?
AFL-2.1 | Academic\s+Free\s+Licen[cs]e[\s,-]*(?:v(?:ersion)?\.?\s*)?2\.1
OSL-3.0 | Open\s+Software\s+Licen[cs]e(?:[\s,-]*(?:v(?:ersion)?\.?\s*)?3(?:\.0)?)?
OSL-2.1 | Open\s+Software\s+Licen[cs]e[\s,-]*(?:v(?:ersion)?\.?\s*)?2\.1
MS-PL | Microsoft\s+Public\s+Licen[cs]e|\bMS-PL\b
MS-RL | Microsoft\s+Reciprocal\s+Licen[cs]e|\bMS-RL\b
NPOSL-3.0 | Non-Profit\s+Open\s+Software\s+Licen[cs]e
QPL-1.0 | \bQ\s+Public\s+Licen[cs]e
RPL-1.5 | Reciprocal\s+Public\s+Licen[cs]e(?:\s*1\.5)?
Sleepycat | Sleepycat\s+(?:Public\s+)?Licen[cs]e
Watcom-1.0 | Sybase\s+Open\s+Watcom\s+Public\s+Licen[cs]e
ZPL-2.1 | Zope\s+Public\s+Licen[cs]e(?:[\s,-]*(?:v(?:ersion)?\.?\s*)?2\.1)?
APSL-2.0 | Apple\s+Public\s+Source\s+Licen[cs]e(?:[\s,-]*(?:v(?:ersion)?\.?\s*)?2(?:\.0)?)?
LPPL-1.3c | LaTeX\s+Project\s+Public\s+Licen[cs]e|\bLPPL\b(?:[\s-]*1\.3c)?
MulanPSL-2.0 | Mulan\s+(?:PSL|Permissive\s+Software\s+Licen[cs]e)(?:[\s,-]*v?(?:ersion)?\.?\s*2(?:\.0)?)?
JSON | \bJSON\s+Licen[cs]e
Beerware | \bBeer-?ware(?:\s+Licen[cs]e)?
FTL | FreeType\s+(?:Project\s+)?Licen[cs]e
IJG | Independent\s+JPEG\s+Group\s+Licen[cs]e
ImageMagick | ImageMagick\s+Licen[cs]e
Intel | Intel\s+Open\s+Source\s+Licen[cs]e
SGI-B-2.0 | SGI\s+Free\s+Software\s+Licen[cs]e
SISSL | Sun\s+Industry\s+Standards\s+Source\s+Licen[cs]e
SPL-1.0 | Sun\s+Public\s+Licen[cs]e
TCL | Tcl/Tk\s+Licen[cs]e
Unicode-3.0 | Unicode\s+Licen[cs]e(?:\s*v3)?
BlueOak-1.0.0 | Blue\s+Oak\s+Model\s+Licen[cs]e
CAL-1.0 | Cryptographic\s+Autonomy\s+Licen[cs]e
Parity-7.0.0 | Parity\s+Public\s+Licen[cs]e
PolyForm-Noncommercial-1.0.0 | PolyForm\s+Noncommercial\s+Licen[cs]e
PolyForm-Small-Business-1.0.0 | PolyForm\s+Small\s+Business\s+Licen[cs]e
Hippocratic-2.1 | Hippocratic\s+Licen[cs]e
OpenRAIL-M | (?:Creative\s*ML\s+)?Open\s?RAIL(?:\+\+)?(?:-M|-S|-D)?(?:\s+Licen[cs]e)?
Llama-Community | Llama\s*\d?(?:\.\d)?\s+Community\s+Licen[cs]e
BigCode-OpenRAIL-M | BigCode\s+Open\s?RAIL-M
"""

# licence | pattern of a page of the licence
_LINKS = r"""
GPL-3.0-only | https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0[\w.-]*
GPL-2.0-only | https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0[\w.-]*
GPL-1.0-or-later | https?://(?:www\.)?gnu\.org/licenses/gpl(?:\.html|\.txt)?\b(?!-)
LGPL-3.0-only | https?://(?:www\.)?gnu\.org/licenses/lgpl-3\.0[\w.-]*
LGPL-2.1-only | https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1[\w.-]*
AGPL-3.0-only | https?://(?:www\.)?gnu\.org/licenses/agpl(?:-3\.0)?[\w.-]*
GFDL-1.3-only | https?://(?:www\.)?gnu\.org/licenses/fdl(?:-1\.3)?[\w.-]*
Apache-2.0 | https?://(?:www\.)?apache\.org/licenses/LICENSE-2\.0[\w.-]*
Apache-1.1 | https?://(?:www\.)?apache\.org/licenses/LICENSE-1\.1[\w.-]*
MIT | https?://(?:www\.)?opensource\.org/licenses?/mit(?:-license)?(?:\.php|\.html)?
MIT | https?://(?:www\.)?mit-license\.org
BSD-3-Clause | https?://(?:www\.)?opensource\.org/licenses?/bsd-3-clause
BSD-2-Clause | https?://(?:www\.)?opensource\.org/licenses?/bsd-2-clause
ISC | https?://(?:www\.)?opensource\.org/licenses?/isc
MPL-2.0 | https?://(?:www\.)?mozilla\.org/(?:en-US/)?MPL/2\.0
MPL-1.1 | https?://(?:www\.)?mozilla\.org/MPL/(?:MPL-)?1\.1[\w.-]*
EPL-2.0 | https?://(?:www\.)?eclipse\.org/legal/epl-2\.0[\w./-]*
EPL-1.0 | https?://(?:www\.)?eclipse\.org/legal/epl-v10[\w.-]*
BSL-1.0 | https?://(?:www\.)?boost\.org/LICENSE_1_0\.txt
Unlicense | https?://(?:www\.)?unlicense\.org
WTFPL | https?://(?:www\.)?wtfpl\.net
CC0-1.0 | https?://creativecommons\.org/publicdomain/zero/1\.0[\w./-]*
CC-PDDC | https?://creativecommons\.org/publicdomain/mark/1\.0[\w./-]*
CC-BY-4.0 | https?://creativecommons\.org/licenses/by/4\.0[\w./-]*
CC-BY-3.0 | https?://creativecommons\.org/licenses/by/3\.0[\w./-]*
CC-BY-2.5 | https?://creativecommons\.org/licenses/by/2\.5[\w./-]*
CC-BY-2.0 | https?://creativecommons\.org/licenses/by/2\.0[\w./-]*
CC-BY-SA-4.0 | https?://creativecommons\.org/licenses/by-sa/4\.0[\w./-]*
CC-BY-SA-3.0 | https?://creativecommons\.org/licenses/by-sa/3\.0[\w./-]*
CC-BY-SA-2.5 | https?://creativecommons\.org/licenses/by-sa/2\.5[\w./-]*
CC-BY-NC-4.0 | https?://creativecommons\.org/licenses/by-nc/4\.0[\w./-]*
CC-BY-NC-3.0 | https?://creativecommons\.org/licenses/by-nc/3\.0[\w./-]*
CC-BY-NC-SA-4.0 | https?://creativecommons\.org/licenses/by-nc-sa/4\.0[\w./-]*
CC-BY-NC-SA-3.0 | https?://creativecommons\.org/licenses/by-nc-sa/3\.0[\w./-]*
CC-BY-ND-4.0 | https?://creativecommons\.org/licenses/by-nd/4\.0[\w./-]*
CC-BY-NC-ND-4.0 | https?://creativecommons\.org/licenses/by-nc-nd/4\.0[\w./-]*
CC-BY-NC-ND-3.0 | https?://creativecommons\.org/licenses/by-nc-nd/3\.0[\w./-]*
ODbL-1.0 | https?://(?:www\.)?opendatacommons\.org/licenses/odbl[\w./-]*
ODC-By-1.0 | https?://(?:www\.)?opendatacommons\.org/licenses/by[\w./-]*
PDDL-1.0 | https?://(?:www\.)?opendatacommons\.org/licenses/pddl[\w./-]*
OFL-1.1 | https?://scripts\.sil\.org/OFL
OGL-UK-3.0 | https?://(?:www\.)?nationalarchives\.gov\.uk/doc/open-government-licence/version/3
EUPL-1.2 | https?://joinup\.ec\.europa\.eu/[\w./-]*eupl[\w./-]*
CDDL-1.0 | https?://(?:www\.)?opensource\.org/licenses?/cddl-?1(?:\.0)?[\w.-]*
Artistic-2.0 | https?://(?:www\.)?opensource\.org/licenses?/artistic-license-2\.0[\w.-]*
BUSL-1.1 | https?://mariadb\.com/bsl11
"""

# licence | pattern of a sentence
_PHRASES = r"""
MIT | Permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy\s+of\s+this\s+software
MIT | The\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included\s+in\s+all\s+copies
ISC | Permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee
BSD-2-Clause | Redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,?\s+with\s+or\s+without\s+modification,?\s+are\s+permitted
BSD-3-Clause | Neither\s+the\s+name\s+of\s+.{1,80}?\s+nor\s+the\s+names\s+of\s+its\s+contributors\s+may\s+be\s+used
BSD-4-Clause | All\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software
Apache-2.0 | you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+License
Apache-2.0 | WITHOUT\s+WARRANTIES\s+OR\s+CONDITIONS\s+OF\s+ANY\s+KIND,\s+either\s+express\s+or\s+implied
GPL-1.0-or-later | This\s+program\s+is\s+free\s+software[;:,]\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+GNU\s+General\s+Public\s+License
GPL-2.0-or-later | either\s+version\s+2\s+of\s+the\s+License,\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version
GPL-3.0-or-later | either\s+version\s+3\s+of\s+the\s+License,\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version
GPL-1.0-or-later | You\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+GNU\s+General\s+Public\s+License
LGPL-2.0-or-later | This\s+library\s+is\s+free\s+software[;:,]\s+you\s+can\s+redistribute\s+it
AGPL-3.0-only | Remote\s+Network\s+Interaction;\s+Use\s+with\s+the\s+GNU\s+General\s+Public\s+License
MPL-2.0 | This\s+Source\s+Code\s+Form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+Mozilla\s+Public\s+License,\s+v\.\s+2\.0
MPL-1.1 | The\s+contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+Mozilla\s+Public\s+License\s+Version\s+1\.1
EPL-1.0 | This\s+program\s+and\s+the\s+accompanying\s+materials\s+are\s+made\s+available\s+under\s+the\s+terms\s+of\s+the\s+Eclipse\s+Public\s+License
Zlib | Altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked\s+as\s+such
Unlicense | This\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain
WTFPL | You\s+just\s+DO\s+WHAT\s+THE\s+FUCK\s+YOU\s+WANT\s+TO
CC0-1.0 | waived\s+all\s+copyright\s+and\s+related\s+or\s+neighbou?ring\s+rights
BSL-1.0 | Permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+or\s+organization\s+obtaining\s+a\s+copy\s+of\s+the\s+software\s+and\s+accompanying\s+documentation
OFL-1.1 | with\s+Reserved\s+Font\s+Name
Beerware | you\s+can\s+buy\s+me\s+a\s+beer\s+in\s+return
PostgreSQL | without\s+fee,\s+and\s+without\s+a\s+written\s+agreement\s+is\s+hereby\s+granted
NCSA | to\s+deal\s+with\s+the\s+Software\s+without\s+restriction
JSON | The\s+Software\s+shall\s+be\s+used\s+for\s+Good,\s+not\s+Evil
OpenSSL | developed\s+by\s+the\s+OpenSSL\s+Project\s+for\s+use\s+in\s+the\s+OpenSSL\s+Toolkit
FTL | Portions\s+of\s+this\s+software\s+are\s+copyright\s+.{1,40}?FreeType
IJG | This\s+software\s+is\s+based\s+in\s+part\s+on\s+the\s+work\s+of\s+the\s+Independent\s+JPEG\s+Group
public-domain | (?:released|placed|dedicated|is|are)\s+(?:in|into|to)?\s*the\s+public\s+domain
proprietary | All\s+rights\s+reserved
proprietary | (?:is\s+)?proprietary\s+and\s+confidential
proprietary | Unauthori[sz]ed\s+copying\s+of\s+this\s+file
proprietary | may\s+not\s+be\s+reproduced\s+(?:in\s+any\s+form\s+)?without\s+(?:prior\s+)?(?:written\s+)?permission
proprietary | for\s+internal\s+use\s+only
non-commercial | (?:for\s+)?non-?commercial\s+(?:use|purposes?)\s+only
copyright-notice | Copyright\s+(?:\(c\)|©)?\s*(?:19|20)\d\d(?:\s*[-,–]\s*(?:19|20)\d\d)*
copyright-notice | ©\s*(?:19|20)\d\d(?:\s*[-,–]\s*(?:19|20)\d\d)*
"""

_GRANT = r"(?:(?:dual[\s-])?licen[cs]ed|released|distributed|published|available|provided|shared|covered|governed|redistribut\w+|used|offered)\s+(?:only\s+)?(?:under|by|subject\s+to|in\s+accordance\s+with)\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?(?:an?\s+)?"
_TAG = r"SPDX-License-Identifier:\s*"
PRIORITY = {"tag": 1, "phrase": 2, "grant": 3, "link": 4, "name": 5, "notice": 6}


class Rule:
    def __init__(self, name: str, licence: str, priority: int, keywords: tuple[str, ...], pattern: str) -> None:
        self.name, self.licence, self.priority, self.keywords = name, licence, priority, keywords
        self.pattern = re.compile(pattern, re.IGNORECASE)


#: Strings that a part of a pattern may be spelt out into.
_SPELLINGS = 48
_SPACE = (op.CATEGORY, op.CATEGORY_SPACE)


def _product(a: set[str], b: set[str] | None) -> set[str] | None:
    """Concatenations, with one blank for each run of white space."""
    out = None if b is None or len(a) * len(b) > 4 * _SPELLINGS else {re.sub(" +", " ", x + y) for x in a for y in b}
    return out if out is None or len(out) <= _SPELLINGS else None


def _spelt(part) -> set[str] | None:
    """All strings that an element of a parsed pattern matches, or None where they are too many."""
    kind, value = part
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return {""}
    if kind is op.IN:
        ok = all(x == _SPACE or x[0] is op.LITERAL for x in value)
        return {" " if x == _SPACE else chr(x[1]).lower() for x in value} if ok else None
    if kind is op.SUBPATTERN:
        return _spelt_all(value[-1])
    if kind is op.BRANCH:
        every = [_spelt_all(x) for x in value[1]]
        return None if None in every else set().union(*every)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        own = _spelt_all(inner)
        if own is None or (high != 1 and own != {" "}):
            return None
        return own if low else own | {""}
    return None


def _spelt_all(parts) -> set[str] | None:
    out: set[str] | None = {""}
    for part in parts:
        out = _product(out, _spelt(part))
        if out is None:
            return None
    return out


def _needed(parts) -> set[str]:
    """Strings, one of which any match contains; {""} where none are known."""
    found: list[set[str]] = []
    now = {""}
    for part in parts:
        own = _spelt(part)
        joined = _product(now, own)
        if joined is not None:
            now = joined
            continue
        found.append(now)
        now = own or {""}
        kind, value = part
        if own is None and kind is op.SUBPATTERN:
            found.append(_needed(value[-1]))
        elif own is None and kind is op.BRANCH:
            found.append(set().union(*map(_needed, value[1])))
        elif own is None and kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0]:
            found.append(_needed(value[2]))
    found = [{x.strip() for x in s} for s in [*found, now]]
    return max(found, key=lambda s: (min(map(len, s)), -len(s)))


def keywords_of(pattern: str) -> tuple[str, ...]:
    """Lower-case strings, one of which every match holds once its white space is collapsed."""
    every = _needed(_parser.parse(pattern, re.IGNORECASE))
    if "" in every:
        raise ValueError(f"no keyword for {pattern}")
    return tuple(sorted(x for x in every if not any(y != x and y in x for y in every)))


def _lines(block: str) -> list[tuple[str, str]]:
    return [tuple(line.split(" | ", 1)) for line in block.strip().splitlines()]


def rules() -> list[Rule]:
    """All rules in order: the first of equal priority wins a tie."""
    out: list[Rule] = []
    names = [(x, keywords_of(p), p) for x, p in _lines(_NAMES)]
    for licence in dict.fromkeys(x for x, _, _ in names):
        if not licence.endswith("unspecified"):
            pattern = rf"{_TAG}{re.escape(licence)}(?![\w.+-])"
            out.append(Rule(f"tag:{licence}", licence, PRIORITY["tag"], keywords_of(pattern), pattern))
    for n, (licence, pattern) in enumerate(_lines(_PHRASES)):
        kind = "notice" if licence in ("copyright-notice", "proprietary", "public-domain", "non-commercial") else "phrase"
        out.append(Rule(f"{kind}:{licence}:{n}", licence, PRIORITY[kind], keywords_of(pattern), pattern))
    # a grant holds a match of the name
    out += [Rule(f"grant:{x}:{n}", x, PRIORITY["grant"], k, rf"\b{_GRANT}(?:{p})") for n, (x, k, p) in enumerate(names)]
    out += [Rule(f"link:{x}:{n}", x, PRIORITY["link"], keywords_of(p), p) for n, (x, p) in enumerate(_lines(_LINKS))]
    out += [Rule(f"name:{x}:{n}", x, PRIORITY["name"], k, p) for n, (x, k, p) in enumerate(names)]
    return out
