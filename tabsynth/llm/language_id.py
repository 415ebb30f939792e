"""Language identification by words first, then ever shorter character n-grams.

A known word is scored by its log relative frequency in each language.  An unseen word is
scored by the mean over its longest n-grams of which at least one is known, from ``longest``
down to single characters.  A text's score is the sum over its words.

The model is fitted on a bounded sample of the labelled rows (about ``sample_per_language``
documents of each language, picked by a hash of the id) and holds at most ``max_words`` words
and ``max_grams`` n-grams of each length, so what is sent to the executors is bounded."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import default_ranges
from .common import blank, fold

UNDETERMINED = "und"
WORD = r"\p{L}[\p{L}\p{M}]*"
PENALTY = 7.0  # minus log10 of the frequency of what a language has never shown


def fit(train: DataFrame, sample_per_language: int = 800, longest: int = 5, max_words: int = 60_000,
        max_grams: int = 20_000, penalty: float = PENALTY) -> dict:
    """Model from (doc_id, text, lang) rows; rows without text or language teach nothing."""
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    width = max(1, len(languages))
    found: dict[int, tuple[list[str], list]] = {n: ([], []) for n in range(longest + 1)}  # 0: words
    if languages:
        draw = F.pmod(F.xxhash64(F.lit("language sample"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_per_language / sizes[lang]))])
        words = (train.where(draw < share[F.col("lang")])
                 .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(1))).alias("item"))
                 .groupBy("lang", "item").agg(F.count(F.lit(1)).alias("count"))
                 .repartition(default_ranges(train.sparkSession), "item"))
        padded, word = F.concat(F.lit(" "), F.col("item"), F.lit(" ")), F.struct(F.lit(0).alias("n"), F.col("item"))
        grams = [F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - (n - 1))),
                             lambda i, n=n: F.struct(F.lit(n).alias("n"), padded.substr(i, F.lit(n)).alias("item"))) for n in range(1, longest + 1)]
        parts = words.select("lang", "count", F.explode(F.concat(F.array(word), *grams)).alias("part"))
        counts = (parts.where(F.when(F.col("part.n") > 0, F.length("part.item") == F.col("part.n")).otherwise(True))
                  .groupBy("lang", "part").agg(F.sum("count").alias("count")).persist())
        totals = {(r["n"], r["lang"]): r["count"] for r in counts.groupBy("part.n", "lang").agg(F.sum("count").alias("count")).collect()}
        items = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("by"), F.sum("count").alias("count"))
        best = [items.where(F.col("part.n") == n).orderBy(F.desc("count"), "part.item").limit(max_grams if n else max_words) for n in range(longest + 1)]
        for r in reduce(DataFrame.union, best).select("part.n", "part.item", "by").collect():
            found[r["n"]][0].append(r["item"])
            found[r["n"]][1].append([math.log10(r["by"][x] / totals[r["n"], x]) if x in r["by"] else -penalty for x in languages])
        counts.unpersist()
    return {"languages": languages, "longest": longest,
            "words": (found[0][0], np.array(found[0][1]).reshape(-1, width)),
            "grams": ([g for n in range(1, longest + 1) for g in found[n][0]],
                      np.array([x for n in range(1, longest + 1) for x in found[n][1]]).reshape(-1, width))}


class Scorer:
    """Applies a model to texts; the scores of unseen words are remembered up to a bound."""

    def __init__(self, model: dict, remembered: int = 200_000):
        import regex

        self.languages, self.longest, self.remembered = model["languages"], model["longest"], remembered
        self.find, self.words = regex.compile(WORD).findall, model["words"]
        self.grams, self.gram_table = {g: i for i, g in enumerate(model["grams"][0])}, model["grams"][1]
        self._start()

    def _start(self):
        items, scores = self.words
        self.number = {w: i for i, w in enumerate(items)}
        self.table = np.zeros((len(items) + self.remembered, scores.shape[1]))
        self.table[:len(items)] = scores

    def unseen(self, word: str) -> np.ndarray:
        padded = f" {word} "
        for n in range(min(self.longest, len(padded)), 0, -1):
            got = [g for i in range(len(padded) - n + 1) if (g := self.grams.get(padded[i:i + n])) is not None]
            if got:
                return self.gram_table[got].mean(0)
        return np.zeros(self.table.shape[1])

    def _add(self, word: str) -> int:
        at = self.number[word] = len(self.number)
        self.table[at] = self.unseen(word)
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, share of the likelihood); ties go to the first language by name."""
        words = self.find(text.lower()) if text else []
        if not words or not self.languages:
            return UNDETERMINED, 0.0
        total = np.zeros(len(self.languages))
        for at in range(0, len(words), 50_000):
            some = words[at:at + 50_000]
            if len(self.number) + len(some) > len(self.table):
                self._start()
            get, add = self.number.get, self._add
            places = [p if (p := get(w)) is not None else add(w) for w in some]
            total += self.table[places].sum(0)
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp((total - total[best]) * math.log(10)).sum())


def identify(spark: SparkSession, docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` as one struct column ``row`` with lang_pred and score for every row.

    A null text, one without letters, or a model without languages gives ``und`` and 0."""
    shared = spark.sparkContext.broadcast({"model": model})
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), blank("text").alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        state = shared.value
        scorer = state.get("scorer") or state.setdefault("scorer", Scorer(state["model"]))
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["row", "lang_pred", "score"])

    return packed.mapInArrow(run, schema)


def predict_languages(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row: learns from the text and non-null
    lang of rows whose fold is not 0 (see ``fold``), predicts every row from its text alone."""
    model = fit(docs.select("doc_id", "text", "lang").where(fold("doc_id") != 0), **options)
    needed = docs.select("doc_id", "text")
    return identify(spark, needed, model).select(
        F.col("row.doc_id").alias("doc_id"), (fold("row.doc_id") == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents in a determined language, with all their columns."""
    model = fit(docs.select("doc_id", "text", "lang").where(fold("doc_id") != 0))
    return identify(spark, docs, model).where(F.col("lang_pred") != UNDETERMINED).select("row.*")
