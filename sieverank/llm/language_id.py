"""Language identification by Bayesian evidence fusion.

For each document four kinds of evidence add up in log space:

* text: a naive Bayes likelihood over byte trigrams, hashed into BUCKETS, for each language; the whole text counts.
  Trigrams with a digit or a sign say nothing about a language and are left out. Neighbouring trigrams share bytes, so the sum is divided by three. The class "und" (no known language) gives each
  bucket the same probability and wins on texts whose trigrams no language explains;
* the language that the markup declares, by how often declarations agreed with the text's verdict;
* the address suffix: the share of each language among the suffix's documents, smoothed towards the overall share
  (SUFFIX_WEIGHT pseudo-documents);
* the host: its share of each language, smoothed towards that of its suffix (HOST_WEIGHT pseudo-documents), or towards
  the overall share where no suffix is known.

Shares are soft counts of the text's verdicts over all documents, by grouped aggregation. The trigram table is fitted
on at most TRAINING_ROWS labelled rows of each language, those with the smallest hash of their id (a bound that is a
parameter). Every language that labels a row is a class, however rare it is.

A document is rejected if no language is found in it: its best class is "und", its text is null, empty or without
letters, or its best class has less than CONFIDENCE. Defined results: rows are judged one by one, repeated or without id; missing hosts,
suffixes and declarations are no evidence; without any labelled row every document is "und"; ties go to the language
that comes first by name; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieverank.llm.batching import slices, tidy
from sieverank.session import ensure_checkpoint_dir

BUCKETS = 1 << 16
TRAINING_ROWS = 5000
SMOOTHING, HOST_WEIGHT, SUFFIX_WEIGHT, CONFIDENCE = 0.5, 20.0, 20.0, 0.5
UNKNOWN = "und"


#: Bytes as trigrams see them: blanks are one, letters and bytes beyond ASCII themselves, others (0) void a trigram.
SEEN = np.zeros(256, np.uint32)
SEEN[list(b" \t\n\r\x0b\x0c")] = 32
SEEN[97:123] = np.arange(97, 123)
SEEN[128:] = np.arange(128, 256)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of the texts (lower-case A-Z, a blank on either side), and where each text begins.

    The bucket BUCKETS stands for trigrams that do not count.
    """
    raw = [b" " + t.encode("utf-8", "surrogatepass").lower() + b" " for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    data = SEEN[np.frombuffer(b"".join(raw) + b"  ", dtype=np.uint8)]
    codes = data[:-2] * np.uint32(0x9E3B) + data[1:-1] * np.uint32(0x01F7) + data[2:]
    codes ^= codes >> np.uint32(11)
    begin = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else np.zeros(0, np.int64)
    counts = (data[:-2] > 0) & (data[1:-1] > 0) & (data[2:] > 0) & (np.maximum(np.maximum(data[:-2], data[1:-1]), data[2:]) > 32)
    return np.where(counts, codes & np.uint32(BUCKETS - 1), np.uint32(BUCKETS)).astype(np.int64), begin


class Model:
    """Log-likelihood table [BUCKETS + 1, languages + 1]; the last column is UNKNOWN, the last row counts for nothing."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        columns = []
        for language in self.languages:
            c = counts[language].astype(np.float64) + SMOOTHING
            columns.append(np.log(c / c.sum()))
        columns.append(np.full(BUCKETS, -np.log(BUCKETS)))
        self.table = np.zeros((BUCKETS + 1, len(columns)), np.float32)
        self.table[:-1] = np.stack(columns, axis=1) / 3.0

    @property
    def classes(self) -> list[str]:
        return [*self.languages, UNKNOWN]

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        """Rows of log-likelihoods; zero for texts without a trigram that counts."""
        out = np.zeros((len(texts), len(self.classes)))
        for part in slices(texts):
            codes, begin = trigrams(texts[part])
            for k in range(len(self.classes)):
                column = np.ascontiguousarray(self.table[:, k])
                out[part, k] = np.add.reduceat(column[codes].astype(np.float64), begin)
        return out


def training_rows(docs: DataFrame, label: Column, id_col: str = "doc_id", rows: int = TRAINING_ROWS) -> DataFrame:
    """id, label: for each label the `rows` smallest hashes of ids, all of a label that has fewer.

    What is clearly too large goes by its hash before rows of one label meet: hashes are uniform, and twice the wanted
    share, with a margin, holds the wanted rows.
    """
    labelled = docs.select(F.col(id_col).cast("string").alias("id"), label.cast("string").alias("label")).filter("label is not null").distinct()
    labelled = labelled.withColumn("h", F.xxhash64("id"))
    sizes = labelled.groupBy("label").agg(F.count("*").alias("size"))
    place = F.col("h").cast("double") / 2.0**64 + 0.5  # 0 to 1
    near = labelled.join(F.broadcast(sizes), "label").filter((F.col("size") <= 2 * rows + 100) | (place * F.col("size") <= 2 * rows + 100))
    order = F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))
    return near.withColumn("at", order).filter(F.col("at") <= rows).select("id", "label")


def fit(docs: DataFrame, label: Column, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS) -> Model:
    """Counts trigrams of at most `rows` labelled rows of each language; what comes to the driver is at most BUCKETS rows a language."""
    chosen = training_rows(docs, label, id_col, rows)
    texts = docs.select(F.col(id_col).cast("string").alias("id"), label.alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), ["id", "label"], "left_semi").select("label", "text")

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, group in batch.groupby("label"):
                texts = group["text"].tolist()
                for part in slices(texts):
                    codes, _ = trigrams(texts[part])
                    seen[language] = seen.get(language, 0) + np.bincount(codes, minlength=BUCKETS + 1)[:BUCKETS]
        for language, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"label": language, "bucket": np.r_[at, -1], "n": np.r_[counts[at], 0]})  # -1: the language occurs

    sums = sample.mapInPandas(tidy(count), "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    table = sums.toPandas()
    counts = {}
    for language, group in table.groupby("label"):
        counts[language] = np.zeros(BUCKETS)
        counts[language][group["bucket"][group["bucket"] >= 0]] = group["n"][group["bucket"] >= 0]
    return Model(counts)


def softmax(log: Column) -> Column:
    """Probabilities from an array of logs."""
    top = F.array_max(log)
    parts = F.transform(log, lambda x: F.exp(x - top))
    return F.transform(parts, lambda p: p / F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def _shares(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """Soft counts of each class by key; partial sums come before the shuffle."""
    return df.groupBy(*by).agg(*[F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(k)])


def identify(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    suffix: Column | None = None,
    declared: Column | None = None,
) -> DataFrame:
    """doc_id, language, confidence, rejected for each row. host, suffix and declared are expressions over docs."""
    ensure_checkpoint_dir(docs.sparkSession)
    nothing = F.lit(None).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        *[(nothing if c is None else c.cast("string")).alias(n) for n, c in (("host", host), ("suffix", suffix), ("declared", declared))],
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            log = model.likelihoods(texts)
            yield batch[["doc_id", "host", "suffix", "declared"]].assign(empty=~log.any(axis=1), log=list(log))

    k = len(model.classes)
    scored = rows.mapInPandas(tidy(run), "doc_id long, host string, suffix string, declared string, empty boolean, log array<double>")
    scored = scored.withColumn("p", softmax(F.col("log"))).checkpoint()
    real = scored.filter("not empty")
    overall = _shares(real, [], k).select(F.array(*[F.coalesce(f"n{i}", F.lit(0.0)) + 1.0 for i in range(k)]).alias("n"))
    share = overall.select(F.transform("n", lambda x: x / F.aggregate("n", F.lit(0.0), lambda a, y: a + y)).alias("share")).scalar()
    out = scored.withColumn("share", share)
    total = sum((F.col(f"n{i}") for i in range(k)), F.lit(0.0))
    prior = F.col("share")
    for name, given, weight in (("suffix", suffix, SUFFIX_WEIGHT), ("host", host, HOST_WEIGHT)):
        if given is None:
            continue
        table = _shares(real.filter(F.col(name).isNotNull()), [name], k)
        table = table.select(name, F.array(*[F.col(f"n{i}") for i in range(k)]).alias(f"{name}_n"), total.alias(f"{name}_all"))
        out = out.join(table, name, "left").withColumn("prior", prior)
        smooth = F.zip_with(f"{name}_n", "prior", lambda n, s: (n + weight * s) / (F.col(f"{name}_all") + weight))  # noqa: B023
        out = out.withColumn("prior", F.coalesce(smooth, "prior"))
        prior = F.col("prior")
    log = F.zip_with("log", prior, lambda a, b: a + F.log(b))
    if declared is not None:
        names = F.array(*[F.lit(c) for c in model.classes])
        agree = real.filter("declared is not null").agg(F.coalesce(F.sum(F.coalesce(F.try_element_at("p", F.array_position(names, F.col("declared")).cast("int")), F.lit(0.0))), F.lit(0.0)).alias("a"), F.count("*").alias("n"))
        # Agreement of declarations with the text's verdict, between chance and almost certain.
        trust = agree.select(F.least(F.greatest((F.col("a") + 1) / (F.col("n") + 2), F.lit(1.0 / k)), F.lit(0.99))).scalar()
        out = out.withColumn("trust", trust)
        said = F.transform(names, lambda c: F.when(c == F.col("declared"), F.log("trust")).otherwise(F.log((1 - F.col("trust")) / max(k - 1, 1))))
        log = F.when(F.array_contains(names, F.col("declared")), F.zip_with(log, said, lambda a, b: a + b)).otherwise(log)
    out = out.withColumn("posterior", softmax(log))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    language = F.when(F.col("empty"), F.lit(UNKNOWN)).otherwise(F.element_at(F.array(*[F.lit(c) for c in model.classes]), best))
    confidence = F.when(F.col("empty"), F.lit(0.0)).otherwise(F.array_max("posterior"))
    out = out.select("doc_id", language.alias("language"), confidence.alias("confidence"))
    return out.withColumn("rejected", (F.col("language") == UNKNOWN) | (F.col("confidence") < CONFIDENCE))


def identify_documents(docs: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """The table of documents: labels are its lang column (in the sample only), hosts its sources."""
    return identify(docs, fit(docs, F.col("lang"), rows=rows), host=F.col("source"))


def identify_pages(pages: DataFrame, model: Model) -> DataFrame:
    """Web pages: page_id as doc_id; markup is taken out of the text before the trigrams, addresses and declarations count."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    name = F.lower(F.try_parse_url("url", F.lit("HOST")))
    declared = F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))
    df = pages.select(F.col("page_id"), text.alias("text"), name.alias("host"), F.nullif(F.regexp_extract(name, r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"), declared.alias("declared"))
    return identify(df, model, id_col="page_id", host=F.col("host"), suffix=F.col("suffix"), declared=F.col("declared"))


def keep_identified(docs: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id") -> DataFrame:
    """docs without the rejected ones; an id goes if all its rows are rejected, rows without an id stay."""
    verdicts = identify_documents(docs, rows).groupBy("doc_id").agg(F.bool_and("rejected").alias("gone"))
    gone = verdicts.filter("gone").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
