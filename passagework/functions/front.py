"""Views of a note's front matter, given as JSON text: sources, events, references, lifecycle, and what waits for review."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions import records

#: Kinds of notes that hold raw material and files that are listings (fixed values).
RAW_KINDS = ("chat-raw", "source", "meeting")
RESERVED = ("index.md", "log.md")
INBOX = "+"
#: Files that a collection ships with (fixed values), and the folders of its tools; any hidden folder at the top is one.
SYSTEM_NAMES = ("AGENTS.md", "AGENTS.override.md", "CLAUDE.md", "claude.md", "LLM-GUIDE.md", "VAULT-RULES.md", "SETUP-GUIDE.md", "Home.md")
SYSTEM_FOLDERS = r"^(?:x|tools|\.[^/]+)/"


def field(front: Column, name: str) -> Column:
    """A value as text; lists and maps as JSON."""
    return F.get_json_object(front, f"$.{name}")


def _entries(raw: Column) -> Column:
    """The elements of a list as text, or the value itself as the only one; none of an empty value."""
    empty = F.array().cast("array<string>")
    one = F.when(F.coalesce(raw, F.lit("")).isin("", "{}"), empty).otherwise(F.array(raw))
    return F.when(F.startswith(raw, F.lit("[")), F.coalesce(F.from_json(raw, "array<string>"), one)).otherwise(one)


def source_entries(front: Column) -> Column:
    """array<struct<resource, title>>: maps with a resource, plain strings, and links that YAML reads as a list in a list."""
    def entry(e: Column) -> Column:
        nested = F.concat(F.lit("[["), F.regexp_replace(e, r'^\[+"?|"?\]+$', ""), F.lit("]]"))
        resource = F.when(F.startswith(e, F.lit("{")), F.trim(F.get_json_object(e, "$.resource"))).when(F.startswith(e, F.lit("[")), nested).otherwise(F.trim(e))
        return F.struct(F.coalesce(resource, F.lit("")).alias("resource"), F.when(F.startswith(e, F.lit("{")), F.get_json_object(e, "$.title")).alias("title"))

    return F.filter(F.transform(_entries(field(front, "sources")), entry), lambda s: ~s["resource"].isin("", "[[]]"))


def source_refs(front: Column) -> Column:
    return F.transform(source_entries(front), lambda s: s["resource"])


def as_wikilink(resource: Column) -> Column:
    """A link for a resource: links and addresses stay, a path becomes its stem in double brackets."""
    r = F.trim(resource)
    stem = F.regexp_replace(F.substring_index(r, "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.when((r == "") | r.rlike(r"^\[\[.*\]\]$") | r.rlike(r"^[a-z][a-z0-9+.-]*://"), r).otherwise(F.concat(F.lit("[["), stem, F.lit("]]")))


def path_entry(path: Column, title: Column | None = None) -> Column:
    """struct(resource, title) for a file of the same bundle; an address stays as it is, without a title."""
    p = F.trim(path)
    address = p.rlike(r"^[a-z][a-z0-9+.-]*://")
    stem = F.regexp_replace(F.substring_index(p, "/", -1), r"(?<=.)\.[^.]*$", "")
    own = F.concat(F.lit("/"), F.regexp_replace(p, "^/+", ""))
    return F.struct(F.when(address, p).otherwise(own).alias("resource"), F.when(~address, F.coalesce(F.nullif(title, F.lit("")) if title is not None else F.lit(None).cast("string"), stem)).alias("title"))


def ref_entry(ref: Column, own_source: Column) -> Column:
    """struct(resource, title) for a "source:path" reference: a path of the record's own source is a bundle path, others stay."""
    source, path = F.substring_index(ref, ":", 1), F.when(F.contains(ref, F.lit(":")), F.regexp_replace(ref, "^[^:]*:", "")).otherwise("")
    stem = F.regexp_replace(F.substring_index(F.when(path == "", ref).otherwise(path), "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.when((path != "") & (source == own_source), path_entry(path)).otherwise(F.struct(ref.alias("resource"), stem.alias("title")))


def _event(e: Column) -> Column:
    return F.struct(F.coalesce(F.trim(F.get_json_object(e, "$.by")), F.lit("")).alias("by"), F.coalesce(F.trim(F.get_json_object(e, "$.at")), F.lit("")).alias("at"))


def verified(front: Column) -> Column:
    """array<struct<by, at>>: the events that name who verified; a single map counts as a list of one."""
    maps = F.filter(_entries(field(front, "verified")), lambda e: F.startswith(e, F.lit("{")))
    return F.filter(F.transform(maps, _event), lambda e: e["by"] != "")


def generated(front: Column) -> Column:
    """struct<by, at>, null where nobody is named."""
    raw = field(front, "generated")
    e = _event(raw)
    return F.when(F.startswith(raw, F.lit("{")) & (e["by"] != ""), e)


def run_record(front: Column) -> Column:
    """The record of the run that wrote a recap, as JSON: `session`, or `harvest` of older ones."""
    own = lambda name: F.when(F.startswith(field(front, name), F.lit("{")), field(front, name))
    return F.coalesce(own("session"), own("harvest"))


def is_recap(front: Column) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(run_record(front)), "extractor"), F.lit(False))


def lifecycle(front: Column) -> Column:
    return records.lifecycle(field(front, "status"), field(front, "draft"))


def is_draft(front: Column) -> Column:
    return lifecycle(front)["status"] == "draft"


def is_deprecated(front: Column) -> Column:
    return lifecycle(front)["status"] == "deprecated"


def is_pending(front: Column) -> Column:
    """A recap that waits for its review."""
    return is_recap(front) & is_draft(front)


def view(front: Column, now: Column) -> Column:
    """struct(status, known, trust, stale, stale_after, intensity, description): what a reader derives from the front matter."""
    life = lifecycle(front)
    after = F.coalesce(records.instant(field(front, "stale_after")), records.instant(field(front, "valid_until")))
    return F.struct(
        life["status"].alias("status"), life["known"].alias("known"), records.trust(F.transform(verified(front), lambda e: e["by"])).alias("trust"), F.coalesce(now >= after, F.lit(False)).alias("stale"),
        after.alias("stale_after"), records.intensity(field(front, "intensity"), field(front, "status")).alias("intensity"), records.description(field(front, "description"), field(front, "summary")).alias("description"),
    )


def is_reserved(path: Column, front: Column) -> Column:
    """Listings, unless the file says that it is a note of some type."""
    return F.substring_index(path, "/", -1).isin(*RESERVED) & (F.coalesce(F.trim(field(front, "type")), F.lit("")) == "")


def is_system(path: Column, managed: Column | None = None) -> Column:
    """Files that a collection ships with, generated indexes and messages; `managed` lists further ones."""
    name = F.substring_index(path, "/", -1)
    own = (~F.contains(path, F.lit("/")) & name.isin(*SYSTEM_NAMES)) | path.rlike(SYSTEM_FOLDERS) | F.endswith(name, F.lit("_index.md")) | F.startswith(name, F.lit("MSG_FROM_"))
    return own if managed is None else own | F.array_contains(managed, path)


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path fits a glob (its * and ? also cross folders) or lies in a named folder."""
    import fnmatch

    tests = [path.rlike("^" + fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$")) | F.startswith(path, F.lit(p.rstrip("/") + "/")) for p in patterns]
    found = F.lit(False)
    for t in tests:
        found |= t
    return found


def blocked(front: Column) -> Column:
    """Why a note can't be approved as it is: locked, raw, not_draft; null if nothing speaks against it."""
    raw = F.lower(F.coalesce(field(front, "type"), F.lit(""))).isin(*RAW_KINDS) | F.coalesce(field(front, "source_type") == "clip", F.lit(False))
    return F.when(F.coalesce(field(front, "lock") == "true", F.lit(False)), "locked").when(raw, "raw").when(~is_draft(front), "not_draft")


def not_approvable(front: Column) -> Column:
    """The same, and digest for a recap, which is decided item by item."""
    return F.coalesce(blocked(front), F.when(is_recap(front), "digest"))


def awaits_review(path: Column, front: Column) -> Column:
    """Drafts in the inbox that nobody has routed yet."""
    return F.startswith(path, F.lit(INBOX + "/")) & blocked(front).isNull() & (F.coalesce(field(front, "routed_into"), F.lit("")).isin("", "false", "null", "[]"))


def yaml_block(fields: dict[str, Column]) -> Column:
    """A front matter block from named values, empty ones left out; text that YAML could read as something else is quoted as JSON.

    Values are strings, booleans, numbers, maps or structs (one JSON line), or arrays of strings (a line each).
    """
    lines = [F.lit("---")]
    for name, (value, kind) in fields.items():
        if kind == "string":
            plain = value.rlike(r"^[A-Za-z0-9_./-]+$") & ~F.lower(value).isin("true", "false", "null", "yes", "no", "on", "off") & ~value.rlike(r"^[-+]?\d+(?:\.\d+)?$")
            quoted = F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")
            lines.append(F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.when(plain, value).otherwise(quoted))))
        elif kind == "array":
            items = F.array_join(F.transform(value, lambda x: F.concat(F.lit("  - "), F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", ""))), "\n")
            lines.append(F.when(F.size(value) > 0, F.concat(F.lit(f"{name}:\n"), items)))
        else:
            lines.append(F.concat(F.lit(f"{name}: "), F.to_json(value) if kind == "map" else value.cast("string")))
    return F.array_join(F.array_compact(F.array(*lines, F.lit("---"))), "\n")


def safe_title(title: Column, limit: int = 80) -> Column:
    """A file name from a title: reserved characters to blanks, single blanks, no full stop at the ends."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|\n\r\t]+', " "), r"\s+", " ")), r"^\.+|\.+$", "")
    return F.coalesce(F.nullif(F.trim(F.substring(clean, 1, limit)), F.lit("")), F.lit("Untitled"))


def approved(raw: Column, by: Column, at: Column) -> Column:
    """A note's text with `status: draft` (or `draft: true`) made `status: stable` and the check added to `verified`; null where neither line is there.

    Only the front matter's own lines change; a `verified` event that stands on one line stays and the new one follows.
    """
    mark = r"(?m)^(?:status:[ \t]*[\"']?draft[\"']?|draft:[ \t]*true)[ \t]*$"
    block = F.regexp_extract(raw, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    event = F.to_json(F.struct(by.alias("by"), at.alias("at")))
    single = F.regexp_extract(block, r"(?m)^verified:[ \t]*(\{.*\})[ \t]*$", 1)
    changed = F.regexp_replace(block, mark, "status: stable")
    old = F.concat(F.lit("verified: "), single)
    added = F.when(single != "", F.replace(changed, old, F.concat(F.lit("verified: ["), single, F.lit(", "), event, F.lit("]")))).otherwise(F.concat(changed, F.lit("\nverified: "), event))
    return F.when(block.rlike(mark), F.concat(F.lit("---\n"), added, F.substr(raw, F.lit(5) + F.length(block))))
