"""Column functions on text: tokens, folds, stems, masks, slugs and ids. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
#: Kinds of secrets and their patterns, applied in this order (fixed values).
SECRETS = (
    ("openai_key", r"sk-[A-Za-z0-9]{16,}"),
    ("bearer", r"(?i)\bBearer\s+[A-Za-z0-9._\-]{12,}"),
    ("slack", r"\bxox[baprs]-[A-Za-z0-9-]{8,}"),
    ("github", r"\bghp_[A-Za-z0-9]{20,}"),
    ("aws", r"\b(?:AKIA|ASIA)[0-9A-Z]{12,}"),
    ("google", r"\bAIza[0-9A-Za-z._\-]{20,}"),
    ("jwt", r"\beyJ[A-Za-z0-9._\-]{20,}"),
    ("assignment", r"(?i)\b(password|secret|api[_-]?key|token)\s*[:=]\s*\S+"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
MASK = "***MASKED***"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column, least: int = 2) -> Column:
    """Words of at least so many word characters, lower-cased, duplicates kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}{{{least},}}"), F.lit(0))


def prefix_stem(token: Column) -> Column:
    """What a longer word also matches by: its first max(4, n - 3) characters; null under five."""
    return F.when(F.length(token) >= 5, F.substring(token, F.lit(1), F.greatest(F.lit(4), F.length(token) - 3)))


def squeezed(text: Column) -> Column:
    """White space runs to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalised(text: Column) -> Column:
    return F.lower(squeezed(text))


def spoken(text: Column) -> Column:
    """Words only, lower-cased, single blanks between."""
    return F.array_join(tokens(text, 1), " ")


def stems(text: Column) -> Column:
    """Distinct first five characters of words of four or more."""
    return F.array_distinct(F.transform(tokens(text, 4), lambda t: F.substring(t, 1, 5)))


def sentences(text: Column) -> Column:
    """Parts between line ends, and after a full stop, exclamation or question mark before white space; blank ones left out."""
    return F.filter(F.split(text, r"(?U)(?<=[.!?])[\s\x1c-\x1f]+|\n+"), lambda s: s.rlike(r"(?U)[^\s\x1c-\x1f]"))


def turkish_lower(text: Column) -> Column:
    return F.lower(F.translate(text, "İI", "iı"))


def person(name: Column) -> Column:
    """A name for comparison: Turkish letters to ASCII, lower case, single blanks."""
    return F.translate(normalised(F.translate(name, "İIĞÜŞÖÇ", "iigusoc")), "ığüşöç", "igusoc")


def same_person(a: Column, b: Column) -> Column:
    """Equal when folded, or one is the other's first name."""
    x, y = person(a), person(b)
    return (x != "") & (y != "") & ((x == y) | F.startswith(y, F.concat(x, F.lit(" "))) | F.startswith(x, F.concat(y, F.lit(" "))))


def owners(value: Column) -> Column:
    """A comma-separated list of owners without blanks and placeholders (fixed values)."""
    parts = F.transform(F.split(value, ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: ~person(x).isin("", "team", "ekip", "name", "tbd", "todo", "owner", "yok", "-"))


#: What a text with a secret of each kind holds, in lower case for kinds that ignore case; checked before the costlier pattern. Those have no i, whose lower case hangs on the language.
_HOLDS = {
    "openai_key": ("sk-",), "bearer": ("bearer",), "slack": ("xox",), "github": ("ghp_",), "aws": ("AKIA", "ASIA"), "google": ("AIza",), "jwt": ("eyJ",),
    "assignment": ("password", "secret", "key", "token"), "private_key": ("PRIVATE KEY-----",),
}


def _may_hold(text: Column, low: Column, kind: str) -> Column:
    """Whether a text, whose lower case is low, may have a secret of a kind."""
    side = low if kind in ("bearer", "assignment") else text
    held = F.lit(False)
    for word in _HOLDS[kind]:
        held = held | F.contains(side, F.lit(word))
    return held


def masked_with_kinds(text: Column) -> Column:
    """struct<text, kinds>: every kind of secret replaced, kinds in order, and those that were; a kind sees what the kinds before it have left.

    Each pattern runs once over what may hold its secrets, and most texts hold none of any kind.
    """
    state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))

    def step(kind: str, pattern: str) -> Callable[[Column], Column]:
        found = lambda s: F.when(_may_hold(s["text"], F.lower(s["text"]), kind), s["text"].rlike(pattern)).otherwise(False)
        replaced = lambda s: F.struct(F.regexp_replace(s["text"], pattern, MASK).alias("text"), F.array_append(s["kinds"], F.lit(kind)).alias("kinds"))
        return lambda s: F.when(found(s), replaced(s)).otherwise(s)

    for kind, pattern in SECRETS:
        state = once(state, step(kind, pattern))
    return state


def masked(text: Column) -> Column:
    """Every kind of secret replaced, kinds in order."""
    return masked_with_kinds(text)["text"]


def mask_kinds(text: Column) -> Column:
    """The kinds that masked() replaces, in order; a kind sees what the kinds before it have left."""
    return masked_with_kinds(text)["kinds"]


def slug(text: Column, limit: int = 48) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_\s-]", ""), r"[\s_-]+", "-")
    return F.regexp_replace(F.substring(dashed, 1, limit), r"^-+|-+$", "")


def item_id(statement: Column) -> Column:
    return F.substring(F.sha1(F.lower(F.trim(statement))), 1, 10)


def shortened(text: Column, limit: int = 600) -> Column:
    """Cut at the last blank within the limit, with an ellipsis; shorter text as it is."""
    head = F.substring(text, 1, limit)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(" …")))


def clock(seconds: Column) -> Column:
    """Seconds as m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), rest))


def seconds(text: Column) -> Column:
    parts = F.split(text, ":")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + F.coalesce(F.try_to_number(x, F.lit("999999")).cast("long"), F.lit(0).cast("long")))


def citation(source: Column, path: Column, title: Column) -> Column:
    return F.format_string("%s (%s:%s)", title, source, path)


def decision_of(line: Column) -> Column:
    """The mark of a list item `- [x] ...`: accepted, rejected, or open."""
    mark = F.lower(F.regexp_extract(line, r"^\s*[-*] \[(.)\]", 1))
    return F.when(mark == "x", "accepted").when(mark == "-", "rejected").when(mark == " ", "open")


def plain_key(text: Column) -> Column:
    """A key without accents: letters of Latin scripts to ASCII, what is left outside ASCII dropped."""
    marked = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįıĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
    bare = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
    return F.regexp_replace(F.translate(text, marked + marked.upper() + "İ", bare + bare.upper() + "I"), r"[^\x00-\x7F]", "")


def imported_id(source: Column, path: Column) -> Column:
    """The id of a record that came with a file: a digest of its source and path."""
    return F.concat(F.lit("imp-"), F.substring(F.sha2(F.concat_ws("\n", source, path), 256), 1, 24))


def guessed_name(mail: Column, names: Column) -> Column:
    """The name (of an array of names) that a mail's local part says: a whole name first, else the longest whose first name it begins with."""
    local = person(F.regexp_replace(F.substring_index(F.coalesce(mail, F.lit("")), "@", 1), "[._-]+", " "))
    tight = lambda t: F.replace(t, F.lit(" "), F.lit(""))
    whole = F.filter(names, lambda n: tight(person(n)) == tight(local))
    begins = F.filter(names, lambda n: F.startswith(tight(local), F.element_at(F.split(person(n), " "), 1)))
    longest = F.array_sort(F.transform(begins, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("name"))))
    return F.coalesce(F.try_element_at(whole, F.lit(1)), F.try_element_at(longest, F.lit(1))["name"], F.lit(""))


def moment(value: Column) -> Column:
    """When something was touched: an ISO instant, or a day, which counts as its noon; null for anything else."""
    v = F.trim(value)
    day = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(v, F.lit(" 12:00:00"))))
    return F.coalesce(day, F.try_to_timestamp(v))


def local_day(value: Column, zone: str) -> Column:
    """The day of a UTC instant in a time zone."""
    return F.to_date(F.from_utc_timestamp(F.try_to_timestamp(value), zone))
