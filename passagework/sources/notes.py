"""Notes: Markdown files with front matter, read by Spark's own file scan; archives of them; question tables."""

from __future__ import annotations

import io
import json
import re
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.session import small_batches

#: Larger files are left out, as are folders of tools and hidden ones.
MOST_BYTES = 2_000_000
_HIDDEN = r"(^|/)(\.[^/]*|node_modules|__pycache__|venv)/"
#: Plain words of YAML 1.1 that aren't text.
_WORDS = {w: v for v, words in ((True, "true yes on"), (False, "false no off"), (None, "null ~")) for w in words.split()}


class _Flow:
    """Reads one flow value (quoted or plain text, list, map) from a position on."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def whole(self):
        """The value of the whole text; text that isn't one value throughout is plain."""
        try:
            value = self.value("")
            self.blanks()
            comment = self.text[self.at - 1 : self.at].isspace() and self.text[self.at : self.at + 1] == "#"
            if self.at == len(self.text) or comment:
                return value
        except (ValueError, IndexError):
            pass
        return plain(self.text)

    def blanks(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def value(self, ends: str):
        self.blanks()
        first = self.text[self.at] if self.at < len(self.text) else ""
        if first in ("'", '"'):
            return self.quoted(first)
        if first == "[":
            return self.many("]", lambda: self.value(",]"), list)
        if first == "{":
            return self.many("}", self.pair, dict)
        begin = self.at
        while self.at < len(self.text) and self.text[self.at] not in ends:
            self.at += 1
        return plain(self.text[begin : self.at])

    def quoted(self, mark: str) -> str:
        begin = self.at
        self.at += 1
        while self.text[self.at] != mark or (mark == "'" and self.text[self.at + 1 : self.at + 2] == mark):
            self.at += 2 if mark == '"' and self.text[self.at] == "\\" or self.text[self.at] == mark else 1
        self.at += 1
        raw = self.text[begin : self.at]
        if mark == "'":
            return raw[1:-1].replace("''", "'")
        try:
            return json.loads(raw, strict=False)
        except ValueError:
            return raw[1:-1]

    def many(self, end: str, one: Callable, kind: type):
        self.at += 1
        found = []
        while True:
            self.blanks()
            if self.text[self.at] == end:
                self.at += 1
                return kind(found)
            found.append(one())
            self.blanks()
            if self.text[self.at] == ",":
                self.at += 1
            elif self.text[self.at] != end:
                raise ValueError

    def pair(self) -> tuple:
        key = self.value(":,}")
        self.blanks()
        if self.text[self.at] != ":":
            raise ValueError
        self.at += 1
        return str(key), self.value(",}")


def plain(text: str):
    """A plain YAML 1.1 scalar."""
    text = text.strip()
    if text.lower() in _WORDS or not text:
        return _WORDS.get(text.lower())
    for kind, pattern in ((int, r"[-+]?\d+"), (float, r"[-+]?\d+\.\d+")):
        if re.fullmatch(pattern, text):
            return kind(text)
    return text


def scalar(raw: str):
    """A YAML scalar, flow list or flow map; what follows " #" outside quotes is a comment."""
    raw = raw.strip()
    if raw[:1] not in ("'", '"', "[", "{"):
        raw = re.sub(r"\s+#.*$", "", raw)
    return _Flow(raw).whole()


_KEY = re.compile(r"([A-Za-z0-9_.\-]+)\s*:(?:\s+(.*)|\s*)$")


_HEADER = re.compile(r"([|>])(?:([1-9])([-+])?|([-+])([1-9])?)?(?:\s+#.*)?$")


def block_scalar(header: re.Match, lines: list[str], parent: int) -> str:
    """The text of a literal (|) or folded (>) block scalar from its lines, below a key indented by `parent`.

    Its indentation is the digit's or its first line's; lines that are indented further keep what they have more. Folding makes one line of
    lines of text, except around those further ones; blank lines stay line ends. The end has one line end, none (-) or all (+).
    """
    fold, digit, chomp = header[1] == ">", header[2] or header[5], header[3] or header[4]
    own = parent + int(digit) if digit else next((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), 0)
    rows = [x[own:] if len(x) > own else "" for x in lines]
    while rows and not rows[-1].strip(" "):
        rows.pop()
    text = ""
    for i, row in enumerate(rows):
        before = rows[i - 1] if i else None
        if before is None:
            text = row
        elif not fold or row[:1] in (" ", "\t") or before[:1] in (" ", "\t"):
            text += "\n" + row
        elif not row:
            text += "\n"
        else:
            # a line end is a blank, unless blank lines stand for it
            text += row if not before and text.endswith("\n") and any(rows[:i]) else "\n" + row if not before else " " + row
    if chomp == "-":
        return text
    return text + "\n" * (len(lines) - len(rows) + (1 if rows else 0)) if chomp == "+" else text + "\n" if rows else text


class _Block:
    """Reads maps, lists and block scalars by indentation; a line that is none is left out, and all others stay."""

    def __init__(self, text: str) -> None:
        self.raw = text.removesuffix("\n").split("\n")
        lines = [(len(x) - len(x.lstrip()), x.strip(), n) for n, x in enumerate(self.raw)]
        self.lines = [x for x in lines if x[1] and not x[1].startswith("#")]
        self.at = 0

    def scalar(self, raw: str, indent: int, number: int):
        """The value behind a key or dash on line `number`; a block scalar takes the lines below that are indented more."""
        header = _HEADER.fullmatch(raw)
        if header is None:
            return scalar(raw)
        end = number + 1
        while end < len(self.raw) and (not self.raw[end].strip() or len(self.raw[end]) - len(self.raw[end].lstrip(" ")) > indent):
            end += 1
        while self.at < len(self.lines) and self.lines[self.at][2] < end:
            self.at += 1
        return block_scalar(header, self.raw[number + 1 : end], indent)

    def _dash(self) -> bool:
        return self.lines[self.at][1] == "-" or self.lines[self.at][1].startswith("- ")

    def block(self, least: int):
        """The map or list whose lines are indented by `least` or more, null if there is none."""
        if self.at >= len(self.lines) or self.lines[self.at][0] < least:
            return None
        indent = self.lines[self.at][0]
        return self.items(indent) if self._dash() else self.pairs(indent)

    def items(self, indent: int) -> list:
        found = []
        while self.at < len(self.lines) and self.lines[self.at][0] >= indent:
            if not self._dash():
                if self.lines[self.at][0] == indent:
                    break
                self.at += 1
                continue
            own, text, number = self.lines[self.at]
            content = text[1:].strip()
            if content[:1] not in ("'", '"', "[", "{") and _KEY.fullmatch(content):
                # the item is a map whose first pair stands behind the dash
                inner = own + len(text) - len(text[1:].lstrip())
                self.lines[self.at] = (inner, content, number)
                found.append(self.pairs(inner))
            else:
                self.at += 1
                found.append(self.scalar(content, own, number) if content else self.block(own + 1))
        return found

    def pairs(self, indent: int) -> dict:
        found: dict = {}
        while self.at < len(self.lines) and self.lines[self.at][0] >= indent:
            own, text, number = self.lines[self.at]
            if self._dash() and own == indent and found:
                break
            m = _KEY.fullmatch(text) if own == indent else None
            self.at += 1
            if m is None:
                continue
            if m[2]:
                found[m[1]] = self.scalar(m[2], own, number)
            elif self.at < len(self.lines) and self._dash() and self.lines[self.at][0] >= own:
                found[m[1]] = self.items(self.lines[self.at][0])
            else:
                found[m[1]] = self.block(own + 1)
        return found


def front_matter(raw: str) -> tuple[dict, str]:
    """(front matter, body): scalars, flow collections, and blocks of lists and maps; odd lines are left out."""
    raw = raw.replace("\r\n", "\n")
    m = re.match(r"---[ \t]*\n(.*?\n)?---[ \t]*(?:\n|$)", raw, re.S)
    return (_Block(m[1] or "").pairs(0), raw[m.end() :]) if m else ({}, raw)


def parsed(notes: DataFrame, text: str = "content") -> DataFrame:
    """notes without the text, with front (JSON text) and body; the parser is a small helper on Arrow batches."""
    small_batches(notes.sparkSession)
    rest = [c for c in notes.columns if c != text]
    kinds = ", ".join(f"`{c}` {t}" for c, t in notes.select(*rest).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [front_matter(t or "") for t in b[text]]
            yield b[rest].assign(front=[json.dumps(f, ensure_ascii=False) for f, _ in both], body=[x for _, x in both])

    return notes.select(*rest, text).mapInPandas(run, f"{kinds}, front string, body string")


def read_notes(spark: SparkSession, root: str, source_id: str, pattern: str = "*.md", exclude: str | None = None) -> DataFrame:
    """(source_id, path, digest, content) of every note below root, at most MOST_BYTES long, hidden folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").removeprefix("file:") + "/"
    path = F.substring_index("path", base, -1)
    rows = files.where(F.col("length") <= MOST_BYTES).select(F.lit(source_id).alias("source_id"), path.alias("path"), F.sha2("content", 256).alias("digest"), F.col("content").cast("string").alias("content"))
    rows = rows.where(~F.concat(F.lit("/"), F.col("path")).rlike(_HIDDEN))
    return rows if exclude is None else rows.where(~F.col("path").rlike(exclude))


def titles(notes: DataFrame) -> DataFrame:
    """notes (path, front) with title: the front matter's, else the file's stem."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    return notes.withColumn("title", F.coalesce(F.nullif(F.trim(F.get_json_object("front", "$.title")), F.lit("")), stem))


def read_archives(spark: SparkSession, path: str, most_files: int = 20_000, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(archive, path, content) of the notes in .tar.gz files, streamed; links, upward paths, large and repeated files are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                seen: dict[str, str] = {}
                with tarfile.open(fileobj=io.BytesIO(data), mode="r|gz") as tar:
                    for member in tar:
                        inner = member.name.partition("/")[2] or member.name
                        unsafe = inner.startswith("/") or ".." in inner.split("/")
                        if not member.isfile() or unsafe or not inner.endswith(".md") or member.size > most_bytes or inner in seen:
                            continue
                        if len(seen) >= most_files:
                            raise ValueError(f"{name} holds more than {most_files} notes")
                        seen[inner] = tar.extractfile(member).read().decode("utf-8", "replace")
                yield pd.DataFrame({"archive": name, "path": list(seen), "content": list(seen.values())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, path string, content string")


def question_set(lines: DataFrame) -> DataFrame:
    """(id, question, answerable, expected, confirmed) from lines (value) of Markdown tables; other lines are skipped.

    Cells end at bars that no backslash escapes; only rows whose third cell says yes, partial or no are questions.
    """
    cells = F.transform(F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    rows = lines.where(F.trim("value").startswith("|")).select(cells.alias("c")).where(F.size("c") >= 4)
    answer = F.lower(F.col("c")[2])
    ok = rows.where(answer.isin("yes", "partial", "no") & F.col("c")[0].rlike(r"^[A-Za-z0-9_-]+$"))
    return ok.select(F.col("c")[0].alias("id"), F.col("c")[1].alias("question"), answer.alias("answerable"), F.col("c")[3].alias("expected"), (F.lower(F.element_at("c", -1)) == "[x]").alias("confirmed"))
