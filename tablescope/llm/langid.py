"""Language of web pages by fusing evidence.

The posterior of a language is proportional to the product of a text likelihood (hashed character trigrams counted over
all labelled documents), the likelihood of the language that the page declares, that of the address's suffix, and a prior
of the host.  Declarations, suffixes and hosts are learned from the pages themselves by grouped sums of text posteriors;
a host's prior is drawn towards its domain's, that one towards the prior of all pages, and no page counts for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import text_groups, written
from tablescope.llm.html import main_text
from tablescope.llm.urls import host_of

BUCKETS = 1 << 14
#: Trigrams whose evidence counts in full; more of them add no certainty, as they are not independent.
MOST_EVIDENCE = 50.0
#: Weight of the level above in smoothing, in pages.
DRAW = 4.0

DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]+)", re.I)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the character trigrams of the lower-cased text, with digits as one character and blanks joined."""
    clean = " " + " ".join(re.sub(r"\d", "0", text.lower()).split()) + " "
    c = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    mixed = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - 14)).astype(np.int64)


def trigram_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, bucket, n) over all documents; documents without a language are left out."""
    slim = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0)
            for at, texts in text_groups(batch.column(1)):
                for i, t in enumerate(texts):
                    lang = langs[at + i].as_py()
                    found = np.bincount(trigrams(t), minlength=BUCKETS)
                    sums[lang] = sums[lang] + found if lang in sums else found
        for lang, n in sums.items():
            some = np.flatnonzero(n)
            columns = [pa.array([lang] * len(some)), pa.array(some), pa.array(n[some])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    parts = slim.mapInArrow(run, "lang string, bucket long, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def text_model(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood by language and bucket).  One row per language and bucket comes to the driver."""
    rows = trigram_counts(docs, lang, text).collect()
    langs = sorted({r["lang"] for r in rows})
    counts = np.full((len(langs), BUCKETS), 0.5)
    place = {x: i for i, x in enumerate(langs)}
    for r in rows:
        counts[place[r["lang"]], r["bucket"]] += r["n"]
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def _sums(k: int) -> list[Column]:
    return [F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(k)]


def _array(k: int) -> Column:
    return F.array(*[F.col(f"s{i}") for i in range(k)])


def identify(
    pages: DataFrame, docs: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", lang: str = "lang", text: str = "text"
) -> DataFrame:
    """Key, host, declared, suffix, text_lang, lang and posterior of every page.

    Text comes from the page's main text.  ``declared`` is the language of the html element if it is one of the known
    ones, "other" if it is another, else "none"; ``suffix`` is the last label of the host (empty without a host).  Pages without text
    have a uniform text likelihood, so the other evidence decides; exact ties take the first language by name.  Without
    any labelled document, lang and posterior are null.  Every input row gives a row, other columns are not read.
    """
    langs, table = text_model(docs, lang, text)
    k = len(langs)
    slim = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"), F.col(page).cast("string").alias("_page"))
    kind = slim.schema["_key"].dataType.simpleString()
    known = set(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_groups(batch.column(2)):
                said, logs = [], []
                for t in texts:
                    m = DECLARED.search(t)
                    name = m[1].lower() if m else "none"
                    said.append(name if name in known or name == "none" else "other")
                    found = trigrams(main_text(t))
                    each = table[:, found].sum(1) if len(found) else np.zeros(k)
                    logs.append((each * min(1.0, MOST_EVIDENCE / max(len(found), 1))).tolist())
                n = len(texts)
                columns = [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(logs, pa.list_(pa.float64()))], names=["_key", "_url", "declared", "ll"])

    read = slim.mapInArrow(run, f"_key {kind}, _url string, declared string, ll array<double>")
    url_col = F.coalesce(F.col("_url"), F.lit(""))
    read = read.withColumn("_url", url_col).withColumn("host", host_of(F.col("_url")))
    if not k:
        nothing = F.lit(None).cast("string")
        return read.select(
            F.col("_key").alias(key), "host", "declared", F.substring_index("host", ".", -1).alias("suffix"),
            nothing.alias("text_lang"), nothing.alias("lang"), F.lit(None).cast("double").alias("posterior"),
        )
    top = F.array_max("ll")
    weight = F.transform("ll", lambda x: F.exp(x - top))
    total = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x)
    read = (
        read.withColumn("_w", weight)
        .withColumn("q", F.transform("_w", lambda x: x / total))
        .select(
            "_key", "host", "declared", "ll", "q", F.substring_index("host", ".", -1).alias("suffix"), F.substring_index("host", ".", -2).alias("domain")
        )
    )
    # the text of a page is read once: sums and fusion work on this small table
    read = written(read, "page-evidence")
    names = F.array(*[F.lit(x) for x in langs])
    # as many numbers as there are languages
    over_all = [x or 0.0 for x in read.agg(*_sums(k)).first()]
    by_host = read.groupBy("host").agg(*_sums(k)).select("host", _array(k).alias("of_host"))
    by_domain = read.groupBy("domain").agg(*_sums(k)).select("domain", _array(k).alias("of_domain"))
    by_suffix = read.groupBy("suffix").agg(*_sums(k)).select("suffix", _array(k).alias("of_suffix"))
    by_said = read.groupBy("declared").agg(*_sums(k)).select("declared", _array(k).alias("of_said"))
    # one row per declared value (at most the languages and two): size known
    joined = (
        read.withColumn("all", F.array(*[F.lit(x) for x in over_all])).join(F.broadcast(by_said), "declared")
        .join(by_suffix, "suffix").join(by_domain, "domain").join(by_host, "host")
    )

    def without_self(name: str, i: int) -> Column:
        return F.greatest(F.col(name)[i] - F.col("q")[i], F.lit(0.0))

    def mass(name: str) -> Column:
        return sum((without_self(name, i) for i in range(1, k)), without_self(name, 0))

    for name in ("all", "of_domain", "of_host"):
        joined = joined.withColumn(f"m_{name}", mass(name))
    scores = []
    for i in range(k):
        base = (without_self("all", i) + 1.0 / k) / (F.col("m_all") + 1.0)
        domain = (without_self("of_domain", i) + DRAW * base) / (F.col("m_of_domain") + DRAW)
        host = (without_self("of_host", i) + DRAW * domain) / (F.col("m_of_host") + DRAW)
        # likelihoods of what the page says, given the language, drawn towards saying nothing about it
        said = (without_self("of_said", i) + DRAW * 0.1) / (without_self("all", i) + DRAW)
        suffix = (without_self("of_suffix", i) + DRAW * 0.1) / (without_self("all", i) + DRAW)
        scores.append(F.col("ll")[i] + F.ln(host) + F.ln(said) + F.ln(suffix))
    best = F.array_max("score")
    sum_exp = F.aggregate(F.transform("score", lambda x: F.exp(x - F.array_max("score"))), F.lit(0.0), lambda a, x: a + x)
    return joined.withColumn("score", F.array(*scores)).select(
        F.col("_key").alias(key), "host", "declared", "suffix",
        F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int")).alias("text_lang"),
        F.element_at(names, F.array_position("score", best).cast("int")).alias("lang"),
        F.round(1.0 / sum_exp, 6).alias("posterior"),
    )
