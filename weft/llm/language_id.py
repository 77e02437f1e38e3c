"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence about a page are combined as log-probabilities: its text (hashed byte 4-gram
models, learnt from documents whose language is known), the language that its markup declares, the
suffix of its address, and the host's prior.  How far declarations and suffixes can be trusted, and the
priors, come from grouped sums of the pages' text posteriors over all pages: P(declared | language),
P(suffix | language), and host counts smoothed towards the site's (last two labels), smoothed towards
all pages'.  A page's own posterior is left out of its host's and site's counts.

The text models are fitted on a bounded, hash-chosen sample (``SAMPLE`` documents); everything else
covers all pages.  Host and site tables are broadcast up to a checked size and joined by key beyond, where
adaptive execution splits a host that holds much.

Edge cases: a null or empty page has no text evidence and is decided by the rest; a null address has
the host ''; a page without a declaration has the declaration 'none', one of an unknown language
'other'; equal posteriors go to the alphabetically first language; with no labelled document every
language is null with posterior 0; of more than ``MOST_LANGUAGES`` languages the rarest have no model and
are never found; repeated pages are judged each; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._scratch import stored, with_key_table
from weft.llm._text import MIX_A, U64, list_array, words_of

BUCKETS = 1 << 16
SAMPLE = 20_000
#: 4-grams after which more text adds no certainty, and the weight of one.
GRAMS, TEMPER = 400, 0.25
KAPPA = 4.0  # pseudo-pages that a host or site takes from the level above
MOST_LANGUAGES = 200

_HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)")
_TAG = re.compile(r"<[^<>]*>")
_DECLARED = re.compile(r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?\s*([A-Za-z]{2,3})""")


def visible(html: str | None) -> str:
    """The text of a page: without hidden elements, comments and tags."""
    return unescape(_TAG.sub(" ", _HIDDEN.sub(" ", html or "")))


def grams(text: str) -> np.ndarray:
    """Buckets of the byte 4-grams of a normalised text."""
    data = b" " + b" ".join(words_of(text)) + b" "
    if len(data) < 4:
        return np.zeros(0, np.int64)
    four = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    return ((four.astype(np.uint64) * MIX_A) >> U64(48)).astype(np.int64)


def text_models(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and log P(4-gram | language) as [languages, BUCKETS]."""
    known = docs.filter("lang is not null and text is not null and doc_id is not null")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    languages = sorted(r[0] for r in counts.limit(MOST_LANGUAGES).collect())
    known = known.join(F.broadcast(counts.limit(MOST_LANGUAGES).select("lang")), "lang", "left_semi")
    chosen = known.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id").distinct()
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[place[lang]] += np.bincount(grams(text), minlength=BUCKETS)
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(sums[i, j])], ["i", "j", "n"])

    rows = known.join(F.broadcast(chosen), "doc_id").select("lang", "text").mapInArrow(count, "i long, j long, n long")
    i, j, n = (c.to_numpy() for c in rows.groupBy("i", "j").agg(F.sum("n")).toArrow().columns)
    table = np.full((len(languages), BUCKETS), 0.1)
    table[i, j] += n
    return languages, np.log(table / table.sum(axis=1, keepdims=True))


def _reader(languages: list[str], shipped):
    known = set(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared, evidence = [], []
            for html in batch.column(1).to_pylist():
                said = _DECLARED.search(html or "", 0)
                said = said[1].lower()[:2] if said else "none"
                declared.append(said if said in known or said == "none" else "other")
                at = grams(visible(html))
                mean = shipped.value[:, at].mean(axis=1) if len(at) else np.zeros(len(languages))
                evidence.append((mean - mean.max()) * min(len(at), GRAMS) * TEMPER)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(declared, pa.string()), list_array(evidence, pa.float64())], ["page_id", "host", "declared", "evidence"])

    return run


def _normal(logs: Column) -> Column:
    """Posterior of an array of log-weights."""
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda s, y: s + y))


def _sums(df: DataFrame, keys: list[str], column: str, n: int, name: str) -> DataFrame:
    """Element-wise sums of an array column of n elements, combined before the shuffle."""
    summed = df.groupBy(*keys).agg(*[F.sum(F.col(column)[i]).alias(f"_{i}") for i in range(n)])
    return summed.select(*keys, F.array(*[F.col(f"_{i}") for i in range(n)]).alias(name))


def identify(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per page: ``page_id, host, declared, lang, posterior, text_lang, posteriors``."""
    spark = pages.sparkSession
    languages, table = text_models(docs, sample)
    n = len(languages)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select("page_id", "html", host.alias("host"))
    if not n:
        return rows.select("page_id", "host", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("array<double>").alias("posteriors"))
    shipped = spark.sparkContext.broadcast(table)
    page_type = dict(rows.dtypes)["page_id"]
    read = rows.mapInArrow(_reader(languages, shipped), f"page_id {page_type}, host string, declared string, evidence array<double>")
    labels = F.split("host", r"\.")
    read = read.withColumn("site", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).withColumn("suffix", F.element_at(labels, -1))
    slim = stored(read.withColumn("own", _normal(F.col("evidence"))), "evidence")

    hosts = stored(_sums(slim, ["host", "site"], "own", n, "of_host"), "hosts")
    sites = stored(_sums(hosts, ["site"], "of_host", n, "of_site"), "sites")
    whole = _sums(sites.withColumn("one", F.lit(1)), ["one"], "of_site", n, "all").first()
    total = np.array(whole["all"]) if whole else np.ones(n)
    world = (total + 1) / (total + 1).sum()

    def given(column: str, limit: int | None) -> DataFrame:
        """log P(value | language), add-one smoothed, per value."""
        by = _sums(slim, [column], "own", n, "m")
        kinds = limit or max(1, by.count())
        return stored(by.select(column, F.array(*[F.log((F.col("m")[i] + 1) / F.lit(float(total[i] + kinds))) for i in range(n)]).alias(f"log_{column}")), column)

    said, ends = given("declared", n + 2), given("suffix", None)
    out = with_key_table(slim, hosts.select("host", "of_host"), "host")
    out = with_key_table(out, sites, "site")
    out = with_key_table(with_key_table(out, said, "declared"), ends, "suffix")
    minus = lambda a: F.zip_with(a, "own", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y)
    smooth = lambda counts, above: F.zip_with(counts, above, lambda x, p: (x + KAPPA * p) / (size(counts) + KAPPA))
    out = out.withColumn("of_site", minus("of_site")).withColumn("of_host", minus("of_host"))
    out = out.withColumn("prior", smooth(F.col("of_site"), F.array(*[F.lit(float(w)) for w in world])))
    out = out.withColumn("prior", smooth(F.col("of_host"), F.col("prior")))
    logs = F.zip_with("evidence", F.transform("prior", lambda x: F.log(x)), lambda x, y: x + y)
    logs = F.zip_with(F.zip_with(logs, "log_declared", lambda x, y: x + y), "log_suffix", lambda x, y: x + y)
    out = out.withColumn("posteriors", _normal(logs))
    names = F.array(*[F.lit(x) for x in languages])
    pick = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return out.select("page_id", "host", "declared", pick(F.col("posteriors")).alias("lang"), F.array_max("posteriors").alias("posterior"), pick(F.col("own")).alias("text_lang"), "posteriors")
