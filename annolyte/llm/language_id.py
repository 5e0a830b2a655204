"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of: the likelihood of the text (character trigrams),
the likelihood of the language declared in the markup, that of the address's suffix, and the prior
of the host. Likelihoods of declarations and suffixes and the priors come from grouped
aggregation over all rows; a host's prior is smoothed by its domain's, that by the global one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialize, parts_of

#: Labelled texts that trigrams are counted in at most, those of least hash.
SAMPLE = 2000
#: Cells of the hashed trigram table (a power of two); the pseudo-count of each.
CELLS, SMOOTH = 1 << 16, 0.5
#: A text speaks with the mean of its trigrams times their number, at most this; each counts for this share, as neighbours depend on each other.
MOST, SHARE = 400, 0.25
#: Rows that a parent's distribution counts for in its child's.
STRENGTH = 20.0

#: A host's domain: its last two labels, or three where the last two are a registry's. The registries' labels are fixed values.
DOMAIN = r"((?:[^.]+\.)?(?:com?|org|net|ac|gov|edu|gob|asso)\.[a-z]{2}|[^.]+\.[^.]+|[^.]+)$"
_SCRIPT = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})(?![A-Za-z])", re.I)
#: Three-letter codes (ISO 639-2, B and T) of languages that have a two-letter one: fixed values, for the languages of most pages.
TWO_LETTERS = dict(
    x.split(":")
    for x in (
        "afr:af alb:sq sqi:sq amh:am ara:ar arm:hy hye:hy aze:az baq:eu eus:eu bel:be ben:bn bos:bs bul:bg bur:my mya:my cat:ca chi:zh zho:zh cze:cs ces:cs dan:da dut:nl nld:nl "
        "eng:en epo:eo est:et fin:fi fre:fr fra:fr geo:ka kat:ka ger:de deu:de gle:ga glg:gl gre:el ell:el guj:gu hau:ha heb:he hin:hi hrv:hr hun:hu ice:is isl:is ind:id ita:it "
        "jpn:ja jav:jv kan:kn kaz:kk khm:km kor:ko kur:ku lao:lo lat:la lav:lv lit:lt ltz:lb mac:mk mkd:mk mal:ml mar:mr may:ms msa:ms mlt:mt mon:mn nep:ne nor:no nob:nb nno:nn "
        "pan:pa per:fa fas:fa pol:pl por:pt pus:ps rum:ro ron:ro rus:ru sin:si slo:sk slk:sk slv:sl som:so spa:es srp:sr swa:sw swe:sv tam:ta tel:te tgl:tl tha:th tur:tr ukr:uk "
        "urd:ur uzb:uz vie:vi wel:cy cym:cy xho:xh yid:yi yor:yo zul:zu"
    ).split()
)


def visible(page: str) -> str:
    """The text of markup: without scripts, styles, comments and tags."""
    return html.unescape(_TAG.sub(" ", _SCRIPT.sub(" ", page)))


def cells(text: str) -> np.ndarray:
    """Hashed trigrams of the letters of a text; runs of anything else count as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (codes >= 97) & (codes <= 122) | (codes >= 0xC0)
    codes = np.where(letter, codes, 32)
    if len(codes):
        keep = np.ones(len(codes), bool)
        keep[1:] = letter[1:] | letter[:-1]
        codes = codes[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    a, b, c = codes[:-2].astype(np.uint64), codes[1:-1].astype(np.uint64), codes[2:].astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (a * np.uint64(0x9E3779B1) + b) * np.uint64(0x85EBCA77) + c
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    found = (h >> np.uint64(40)) & np.uint64(CELLS - 1)
    some = (a != 32) | (b != 32) | (c != 32)
    return found[some].astype(np.int64)


class TrigramModel:
    """Log-probabilities of trigrams by language."""

    def __init__(self, counted: dict[str, np.ndarray]):
        self.langs = sorted(counted)
        counts = np.array([counted[x] + SMOOTH for x in self.langs]).reshape(len(self.langs), CELLS)
        self.table = np.ascontiguousarray(np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32))
        if self.langs:
            self.table -= self.table.mean(1, keepdims=True)

    def loglik(self, text: str) -> np.ndarray:
        """By language, up to a constant; zeros for a text without trigrams."""
        found = cells(text)
        n = len(found)
        if not n:
            return np.zeros(len(self.langs))
        total = np.zeros(len(self.langs))
        for i in range(0, n, 100_000):
            total += self.table[found[i : i + 100_000]].sum(0, dtype=np.float64)
        return total / n * min(n, MOST) * SHARE


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> TrigramModel:
    """Counts trigrams of the `sample` labelled rows of least hash."""
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ids = named.select(id_col).distinct().orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(sample)
    chosen = named.join(F.broadcast(ids), id_col).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over a task: a row for each language, whatever the texts' length."""
        sums: dict[str, np.ndarray] = {}
        for part in parts_of(batches, 64):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = sums.setdefault(lang, np.zeros(CELLS, np.int64))
                found += np.bincount(cells(text), minlength=CELLS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "cell", "n"])

    # Added up before they come to the driver: CELLS rows a language at most.
    rows = mapped(chosen, run, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    seen = [r[0] for r in chosen.select("lang").distinct().collect()]
    found = rows.toArrow()
    counted = {lang: np.zeros(CELLS) for lang in seen}
    for lang, cell, n in zip(*(found[c].to_pylist() for c in ("lang", "cell", "n")), strict=True):
        counted[lang][cell] += n
    return TrigramModel(counted)


def evidence(rows: DataFrame, model: TrigramModel) -> DataFrame:
    """rows: kind, id, text, markup (boolean), url, host. Adds nothing of the text but its likelihoods.

    Returns kind, id, host, domain, declared, suffix, ll. Null texts are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 512):
            declared, ll = [], []
            for text, markup in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = text or ""
                m = _DECLARED.search(text) if markup else None
                code = m[1].lower() if m else None
                declared.append(TWO_LETTERS.get(code, code))
                ll.append(model.loglik(visible(text) if markup else text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), batch.column(5), pa.array(declared, pa.string()), pa.array([x.tolist() for x in ll], pa.list_(pa.float64()))],
                ["kind", "id", "url", "host", "declared", "ll"],
            )

    made = mapped(rows.select("kind", "id", "text", "markup", "url", "host"), run, "kind string, id bigint, url string, host string, declared string, ll array<double>")
    host = F.coalesce("host", F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    top = F.regexp_extract("_host", r"\.([a-z]{2})$", 1)
    folder = F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://[^/]+/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    suffix = F.when(top != "", top).when(folder != "", folder)
    return made.withColumn("_host", host).select("kind", "id", F.col("_host").alias("host"), F.regexp_extract("_host", DOMAIN, 1).alias("domain"), "declared", suffix.alias("suffix"), "ll")


def _softmax(values: list[Column]) -> list[Column]:
    top = F.greatest(*values) if len(values) > 1 else values[0]
    parts = [F.exp(v - top) for v in values]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def fuse(found: DataFrame, langs: list[str]) -> DataFrame:
    """Posteriors from evidence rows: kind, id, host, lang, prob, text_lang, declared, suffix."""
    n = len(langs)
    p = [f"p{i}" for i in range(n)]
    found = materialize(found.withColumns(dict(zip(p, _softmax([F.element_at("ll", i + 1) for i in range(n)]), strict=True))), "evidence")
    sums = [F.sum(x).alias(x) for x in p]
    hosts = materialize(found.groupBy("host", "domain").agg(F.count("*").alias("n"), *sums), "hosts")
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n"), *sums)
    whole = hosts.agg(F.sum("n").alias("n"), *sums).first()
    total = float(whole["n"] or 0)
    world = [((whole[x] or 0.0) + 1.0) / (total + n) for x in p]
    # Domain priors by host; hosts and domains are joined by shuffles where they are many.
    dom = domains.select("domain", *[((F.col(x) + STRENGTH * w) / (F.col("n") + STRENGTH)).alias(f"d{i}") for i, (x, w) in enumerate(zip(p, world, strict=True))])
    prior = materialize(hosts.join(dom, "domain").select("host", F.col("n").alias("hn"), *[F.col(x).alias(f"h{i}") for i, x in enumerate(p)], *[f"d{i}" for i in range(n)]), "priors")
    out = found.join(prior, "host")
    logs = []
    for i in range(n):
        own = F.greatest(F.col(f"h{i}") - F.col(p[i]), F.lit(0.0))  # without the row itself
        logs.append(F.log((own + STRENGTH * F.col(f"d{i}")) / (F.col("hn") - 1 + STRENGTH)))
    for what in ("declared", "suffix"):
        # Codes of two or three letters: 18,252 values at most. A value never seen counts as one of 676 of half a row each.
        seen = found.where(F.col(what).isNotNull()).groupBy(what).agg(*[F.sum(x).alias(f"{what}_{x}") for x in p])
        each = found.where(F.col(what).isNotNull()).agg(*sums).first()
        out = out.join(F.broadcast(seen), what, "left")
        for i, x in enumerate(p):
            like = F.log((F.col(f"{what}_{x}") + 0.5) / ((each[x] or 0.0) + 0.5 * 676))
            logs[i] = logs[i] + F.coalesce(like, F.lit(0.0))
    post = _softmax([F.element_at("ll", i + 1) + logs[i] for i in range(n)])
    names = F.array(*[F.lit(x) for x in langs])
    at = lambda values: F.element_at(names, F.array_position(F.array(*values), F.array_max(F.array(*values))).cast("int"))
    out = out.withColumns({f"q{i}": x for i, x in enumerate(post)})
    q = [F.col(f"q{i}") for i in range(n)]
    return out.select("kind", "id", "host", at(q).alias("lang"), (F.greatest(*q) if n > 1 else q[0]).alias("prob"), at([F.col(x) for x in p]).alias("text_lang"), "declared", "suffix")


def identify(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Languages of plain documents (doc_id, text, source) and of web pages (page_id, url, html).

    A document's source is its host; it has no markup and no address. Texts are learnt from
    documents.lang. Null or empty texts, and texts without letters, are decided by the other
    evidence. Each input row gives one row; repeated rows stay. Null hosts share the host "".
    Without any labelled text, lang is null.
    """
    model = train(documents)
    docs = documents.select(F.lit("document").alias("kind"), F.col("doc_id").cast("bigint").alias("id"), "text", F.lit(False).alias("markup"), F.lit(None).cast("string").alias("url"), F.coalesce("source", F.lit("")).alias("host"))
    web = pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("bigint").alias("id"), F.col("html").alias("text"), F.lit(True).alias("markup"), "url", F.lit(None).cast("string").alias("host"))
    rows = docs.unionByName(web)
    if not model.langs:
        none = F.lit(None).cast("string")
        return rows.select("kind", "id", F.coalesce("host", F.lit("")).alias("host"), none.alias("lang"), F.lit(None).cast("double").alias("prob"), none.alias("text_lang"), none.alias("declared"), none.alias("suffix"))
    return fuse(evidence(rows, model), model.langs)
