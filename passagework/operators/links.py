"""Links between pages: extraction, resolution, backlinks, edges, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, href) of every link of a page, repeated ones kept."""
    return pages.select(key, F.explode(F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]+)"'), F.lit(1))).alias("href"))


def note_links(notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, href) of wikilinks, without heading and label, and of relative Markdown links to notes, decoded.

    key is the note's path: Markdown links are paths from the root, taken from the note's folder; those that lead out of the root are left out.
    """
    wiki = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), lambda x: F.trim(x))
    plain = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"(?<!!)\[[^\]]*\]\((?![a-z]+:)([^)#\s]+\.md)"), F.lit(1)), lambda x: F.try_url_decode(x))
    path = F.col(key).cast("string")
    folder = F.when(F.contains(path, F.lit("/")), F.concat(_folder(path), F.lit("/"))).otherwise("")
    rooted = F.transform(plain, lambda x: normal_path(F.when(x.startswith("/"), F.ltrim(x, F.lit("/"))).otherwise(F.concat(folder, x))))
    inside = F.filter(rooted, lambda x: ~x.startswith("../"))
    return notes.select(key, F.explode(F.array_compact(F.concat(wiki, inside))).alias("href"))


def normal_path(path: Column) -> Column:
    """path without empty and '.' parts, each '..' taken with the part before it; a leading slash stays."""
    rooted = path.startswith("/")

    def step(acc: Column, part: Column) -> Column:
        up = (part == "..") & F.when(F.size(acc) == 0, rooted).otherwise(F.element_at(acc, -1) != "..")
        return F.when(~up, F.array_append(acc, part)).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)

    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md\z", "")


def resolved(links: DataFrame, targets: DataFrame, source: str | None = None) -> DataFrame:
    """links (.., href) with the target each leads to; links without a target are dropped. targets has path.

    '.md' counts on neither side. The exact path comes first, then the path from the folder of the linking note (the
    column `source`), then the targets that end with '/' and the href, an href without '/' being a name. Of several
    such targets the one of fewest slashes, then of the least path, holds; they are reduced to one for each ending
    first, so a common name makes no pairs.
    """
    blank = r"[\s\x1c-\x1f]+"
    wanted = F.regexp_replace(_bare(F.regexp_replace("href", rf"(?U)^{blank}|{blank}\z", "")), r"^/+|/+\z", "")
    known = targets.groupBy(_bare(F.col("path")).alias("_bare")).agg(F.max("path").alias("_path"))
    parts = F.split("_bare", "/")
    ends = known.where(F.contains("_bare", F.lit("/"))).select("_path", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("_wanted"))
    best = F.min(F.struct(F.size(F.split("_path", "/")).alias("depth"), F.col("_path").alias("path")))["path"]
    asked = links.withColumn("_wanted", wanted).where("_wanted <> ''")
    steps = [known.select(F.col("_bare").alias("_wanted"), F.col("_path").alias("_exact")), ends.groupBy("_wanted").agg(best.alias("_ending"))]
    found = asked.join(steps[0], "_wanted", "left").join(steps[1], "_wanted", "left")
    near = F.lit(None).cast("string")
    if source is not None:
        path = F.when(F.contains(source, F.lit("/")), normal_path(F.concat(_folder(F.col(source)), F.lit("/"), "_wanted")))
        found = found.withColumn("_at", path).join(known.select(F.col("_bare").alias("_at"), F.col("_path").alias("_near")), "_at", "left")
        near = F.col("_near")
    return found.select(*links.columns, F.coalesce("_exact", near, "_ending").alias("target")).where("target is not null")


def backlinks(linked: DataFrame, page: str, target: str, most: int = 200) -> DataFrame:
    """(target, n_pages, pages): how many pages link to each target, and the first `most` of them."""
    own = linked.select(target, page).distinct()
    first = own.withColumn("_place", F.row_number().over(Window.partitionBy(target).orderBy(page))).where(F.col("_place") <= most)
    listed = first.groupBy(target).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return own.groupBy(target).agg(F.count(F.lit(1)).alias("n_pages")).join(listed, target)


def edges(linked: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, weight): undirected edges between different nodes, a < b, weighted by the links of both directions."""
    pair = linked.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def degrees(edge: DataFrame) -> DataFrame:
    return edge.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
