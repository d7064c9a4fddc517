"""Gates on candidate passages, and the callables that embed, score and extract, injected by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.session import small_batches

#: (questions, texts) to raw scores; one call a batch, so a model is loaded once a worker.
Scorer = Callable[[list[str], list[str]], list[float]]
_PROVIDERS: dict[str, Callable[[], Callable]] = {}


def register(name: str, factory: Callable[[], Callable]) -> None:
    """Make a provider known; the factory runs on the workers, where the model belongs."""
    _PROVIDERS[name] = factory


def provider(name: str) -> Callable[[], Callable]:
    if name not in _PROVIDERS:
        raise ValueError(f"no provider named {name!r}; known are {sorted(_PROVIDERS)}")
    return _PROVIDERS[name]


def embedded(rows: DataFrame, key: str, text: str, factory: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """(key, vector array<float>) by an injected embedding; a batch whose sizes differ is refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = factory()
        for b in batches:
            got = [[float(x) for x in v] for v in embed(b[text].fillna("").tolist())]
            if len(got) != len(b) or len({len(v) for v in got}) > 1:
                raise ValueError("an embedding of another number or size came back")
            yield pd.DataFrame({key: b[key], "vector": got})

    return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, vector array<float>")


def scored(rows: DataFrame, question: str, text: str, factory: Callable[[], Scorer], name: str = "gate_score") -> DataFrame:
    """rows with a raw score from an injected scorer; null where the scorer failed, which lets its rows pass unchanged."""
    small_batches(rows.sparkSession)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = factory()
        for b in batches:
            try:
                got = [float(x) for x in score(b[question].tolist(), b[text].fillna("").tolist())]
                if len(got) != len(b):
                    raise ValueError
            except Exception:  # noqa: BLE001 - a gate that fails must not lose evidence
                got = [None] * len(b)
            yield b.assign(**{name: pd.Series(got, dtype="float64", index=b.index)})

    return rows.mapInPandas(run, f"{kinds}, {name} double")


def reranked(rows: DataFrame, question: str, key: list[str], least: float, name: str = "gate_score") -> DataFrame:
    """Rows strictly above the threshold, best first; a question with a row that has no score keeps all, in their order.

    rows has `rank`, which the new order replaces.
    """
    from pyspark.sql import Window

    own = Window.partitionBy(question)
    failed = F.max(F.col(name).isNull()).over(own)
    kept = rows.withColumn("_failed", failed).where(F.col("_failed") | (F.col(name) > least))
    order = own.orderBy(F.desc(F.when(~F.col("_failed"), F.round(name, 10))), F.asc("rank"), *(F.asc(k) for k in key))
    return kept.withColumn("rank", F.row_number().over(order)).drop("_failed")


def judged(rows: DataFrame, least: float = 0.5, most_injection: float = 0.7) -> DataFrame:
    """Rows (relevance, best, injection, secret) that a judge lets through; secret rows were never shown to it and stay.

    Probabilities outside 0 to 1 and missing ones break the contract: the row passes and is marked unjudged. See
    judged_order() for the order of what is left.
    """
    ok = F.lit(True)
    for c in ("relevance", "best", "injection"):
        ok &= F.coalesce(F.col(c).between(0, 1) & ~F.isnan(c), F.lit(False))
    shown = rows.withColumn("judged", ok & ~F.coalesce(F.col("secret"), F.lit(False)))
    return shown.where(~F.col("judged") | ((F.col("injection") <= most_injection) & (F.col("relevance") >= least)))


def contract_kept(choices: Column, relevance: Column, injection: Column, n: Column, tolerance: float = 0.02) -> Column:
    """Whether a judge's reply for n passages is usable: one probability a passage in each list, all in 0 to 1, the choices summing to about one."""
    unit = lambda xs: F.forall(xs, lambda x: F.coalesce(x.between(0, 1) & ~F.isnan(x), F.lit(False)))
    total = F.aggregate(choices, F.lit(0.0), lambda a, x: a + x)
    right = (F.size(choices) == n) & (F.size(relevance) == n) & (F.size(injection) == n) & unit(choices) & unit(relevance) & unit(injection)
    return F.coalesce(F.when(right, F.abs(total - 1) <= tolerance), F.lit(False))


def judged_order(rows: DataFrame, question: str, key: list[str]) -> DataFrame:
    """rows with a new rank in each question: judged ones by best and then relevance, both descending, then those that weren't judged, in their order.

    rows has judged, best, relevance and rank, as judged() leaves them.
    """
    from pyspark.sql import Window

    shown = F.col("judged")
    order = [F.desc("judged"), F.desc_nulls_last(F.when(shown, F.col("best"))), F.desc_nulls_last(F.when(shown, F.col("relevance"))), F.asc("rank"), *(F.asc(k) for k in key)]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(question).orderBy(*order)))


def extracted(parts: DataFrame, group: str, part: str, text: str, factory: Callable[[], Callable[[str], list[dict]]]) -> DataFrame:
    """(group, part, type, statement, quote, exchange) that an injected callable finds in each packed part.

    Replies that aren't lists of objects give nothing; two tries a part.
    """
    kind = dict(parts.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = factory()
        for b in batches:
            rows = []
            for g, p, t in zip(b[group], b[part], b[text], strict=True):
                for _ in range(2):
                    try:
                        found = ask(t or "")
                    except Exception:  # noqa: BLE001 - the second try, then nothing
                        continue
                    rows += [(g, p, str(x.get("type", "")), str(x.get("statement", "")), str(x.get("quote", "")), x.get("exchange")) for x in found if isinstance(x, dict)]
                    break
            yield pd.DataFrame(rows, columns=[group, part, "type", "statement", "quote", "exchange"]).astype({"exchange": "Int64"})

    return parts.select(group, part, text).mapInPandas(run, f"{group} {kind[group]}, {part} {kind[part]}, type string, statement string, quote string, exchange bigint")


def verified_items(items: DataFrame, places: DataFrame, types: tuple[str, ...] = ("decision", "fact", "preference", "open_item")) -> DataFrame:
    """Items of known types with a place for their quote (item_id, i, speaker), each statement once, the first by item_id."""
    ok = items.where(F.col("type").isin(*types) & (F.trim("statement") != "")).join(places, "item_id")
    first = ok.groupBy(F.lower(F.trim("statement")).alias("_s")).agg(F.min("item_id").alias("item_id"))
    return ok.join(first.select("item_id"), "item_id")
