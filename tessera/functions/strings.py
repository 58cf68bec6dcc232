"""Scalar string functions: document types, resource paths, codecs, analyzer."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The analyzer's token: a run of letters and digits of any script.
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased word tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def doc_type(doc_id: Column) -> Column:
    """The last but one path segment after ``///`` (or of the whole id), else ``unknown``."""
    tail = F.when(F.contains(doc_id, F.lit("///")), F.substring_index(doc_id, "///", -1)).otherwise(doc_id)
    parts = F.split(tail, "/")
    kind = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    return F.when(F.coalesce(kind, F.lit("")) == "", F.lit("unknown")).otherwise(kind)


class InvalidPath(ValueError):
    """A resource path that names no dataset."""


def parse_path(path: str) -> dict[str, str]:
    """org/db[/repo[/branch|commit/name]] to its parts; repo and branch default to local and main."""
    parts = path.strip("/").split("/") if path.strip("/") else []
    if any(not p for p in parts):
        raise InvalidPath(path)
    if len(parts) in (2, 3):
        return {"org": parts[0], "db": parts[1], "repo": parts[2] if len(parts) == 3 else "local", "kind": "branch", "ref": "main"}
    if len(parts) == 5 and parts[3] in ("branch", "commit"):
        return {"org": parts[0], "db": parts[1], "repo": parts[2], "kind": parts[3], "ref": parts[4]}
    raise InvalidPath(path)


def parsed_path(path: Column) -> Column:
    """The same as a struct; null where the path is invalid."""
    p = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    n, at = F.size(p), lambda i: F.try_element_at(p, F.lit(i))
    short, long = n.isin(2, 3), (n == 5) & at(4).isin("branch", "commit")
    ok = (short | long) & ~F.array_contains(p, "")
    return F.when(
        ok,
        F.struct(
            at(1).alias("org"),
            at(2).alias("db"),
            F.coalesce(at(3), F.lit("local")).alias("repo"),
            F.when(long, at(4)).otherwise("branch").alias("kind"),
            F.when(long, at(5)).otherwise("main").alias("ref"),
        ),
    )


def encode_tag(commit: str) -> str:
    """A commit id as a tag name: a hyphen doubled, other marks as hyphen and two hex digits per byte."""
    plain = re.sub(rb"[^A-Za-z0-9_]", lambda m: b"--" if m.group() == b"-" else b"-%02x" % m.group()[0], commit.encode())
    return "c_" + plain.decode("ascii")


def decode_tag(tag: str) -> str | None:
    """The commit id, or None where the name is no tag of this codec."""
    if not re.fullmatch(r"c_(?:[A-Za-z0-9_]|--|-[0-9a-fA-F]{2})*", tag):
        return None
    raw = re.sub(rb"-(-|[0-9a-fA-F]{2})", lambda m: b"-" if m.group(1) == b"-" else bytes.fromhex(m.group(1).decode()), tag[2:].encode())
    return raw.decode("utf-8", "replace")


def tag_name(commit: Column) -> Column:
    """``encode_tag`` as an expression."""
    utf8 = F.hex(F.encode(commit, "UTF-8"))
    plain = F.transform(F.regexp_extract_all(utf8, F.lit("(..)"), 1), lambda h: F.when(h == "2D", "--").when(h.rlike("^(3[0-9]|4[1-9A-F]|5[0-9A]|5F|6[1-9A-F]|7[0-9A])$"), F.decode(F.unhex(h), "UTF-8")).otherwise(F.concat(F.lit("-"), F.lower(h))))
    return F.concat(F.lit("c_"), F.array_join(plain, ""))


def tag_commit(tag: Column) -> Column:
    """``decode_tag`` as an expression; null where the name is no tag of this codec."""
    ok = tag.rlike("^c_(?:[A-Za-z0-9_]|--|-[0-9a-fA-F]{2})*$")
    parts = F.regexp_extract_all(F.substring(tag, 3, 1_000_000), F.lit("(--|-[0-9a-fA-F]{2}|[A-Za-z0-9_])"), 1)
    codes = F.transform(parts, lambda x: F.when(x == "--", "2D").when(F.length(x) == 3, F.substring(x, 2, 2)).otherwise(F.hex(F.encode(x, "UTF-8"))))
    return F.when(ok, F.decode(F.unhex(F.array_join(codes, "")), "UTF-8"))


def encode_domain(org: str, db: str) -> str:
    """Two names as one folder name: percent-encoded, joined by two underscores."""
    return "__".join(quote(x, safe="").replace("_", "%5F") for x in (org, db))


def decode_domain(name: str) -> tuple[str, str] | None:
    parts = name.split("__")
    return (unquote(parts[0]), unquote(parts[1])) if len(parts) == 2 and all(parts) else None


_SEARCH = {"document": "search_document: ", "query": "search_query: ", "clustering": "clustering: ", "classification": "classification: "}
#: model -> role -> what the model wants before a text.
PREFIXES = {f"{owner}nomic-embed-{name}": _SEARCH for owner in ("", "nomic-ai/") for name in ("text-v2-moe", "v2", "text-v1.5")}
ROLES = ("document", "query", "clustering", "classification")


def task_prefix(model: str, role: str) -> str:
    """What a model wants before a text in a role; nothing for models not in the table."""
    if role not in ROLES:
        raise ValueError(f"role must be one of {', '.join(ROLES)}")
    return PREFIXES.get(model, {}).get(role, "")


def cache_key(model: Column, prefixed: Column) -> Column:
    """Key of the embedding cache: SHA-256 of model, line end, prefixed text."""
    return F.sha2(F.concat(model, F.lit("\n"), prefixed), 256)
