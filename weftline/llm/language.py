"""Language identification by Bayesian fusion of evidence.

A text's likelihood under each language comes from byte trigrams counted over the labelled documents. Declared
markup language and the language code in an address are evidence whose reliability is counted over the pages
themselves, against what their texts say. The prior is the host's: its counts are smoothed towards its domain's,
those towards all rows', and a row's own vote is left out. All counts are grouped sums. Hosts of pages and sources
of documents are two name spaces; sources have no domains.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_texts, small_batches, written
from weftline.llm.gam import held_out
from weftline.llm.templates import host_of

BUCKETS = 1 << 15
#: More labelled languages than this are refused, as each takes 256 kB on the driver; none is left out. There are about 200 two-letter codes.
MOST_LANGUAGES = 1000
#: Trigram log-likelihoods are scaled to this many trigrams at most, as trigrams of one text depend on each other.
EVIDENCE = 60
#: Pseudo-counts: of a bucket, of a domain's share in a host, of all pages' share in a domain, of evidence agreeing or not.
ALPHA, HOST, DOMAIN, SIGNAL = 0.5, 4.0, 8.0, 2.0
_HTML = re.compile(rb"<!--(?:>|->|.*?(?:--!?>|\Z))|(?P<tag><html(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)", re.I | re.S)
_LANG = re.compile(rb"[\s\"'/](?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})(?![A-Za-z])", re.I)
_MARKUP = re.compile(rb"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>|&[#A-Za-z0-9]{1,32};", re.I | re.S)


def visible(page: bytes) -> bytes:
    """A page's text, roughly: markup, scripts and character references become spaces."""
    return _MARKUP.sub(b" ", page)


def declared(page: bytes) -> str | None:
    """The language that a page's first html tag outside comments declares, wherever in the page it stands."""
    for m in _HTML.finditer(page):
        if m["tag"]:
            end = m.end() if page[m.end() : m.end() + 1] == b">" else page.find(b">", m.start())  # a quote that never ends
            found = _LANG.search(page, m.start(), end if end >= 0 else len(page))
            return found[1].lower().decode() if found else None
    return None


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of the texts, and where each text's begin. A text is padded, so that each has some."""
    padded = [b" " + t.lower().translate(_FOLD) + b"  " for t in texts]
    a = np.frombuffer(b"".join(padded), dtype=np.uint8).astype(np.uint32)
    at = np.cumsum([0, *map(len, padded)])[:-1]
    x = np.zeros(len(a), dtype=np.uint32)
    x[: len(a) - 2] = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761) >> np.uint32(32 - 15)
    return x, at


_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def _counts(docs: DataFrame, text: str, lang: str) -> dict[str, np.ndarray]:
    """Trigram counts by language over all the rows: each task adds up its own, the sums are grouped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for b in batches:
            for t, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if code not in own:
                    if len(own) >= 64:
                        yield from _emit(own)
                        own = {}
                    own[code] = np.zeros(BUCKETS, dtype=np.int64)
                own[code] += np.bincount(buckets([t])[0], minlength=BUCKETS)
        yield from _emit(own)

    small_batches(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(text).cast("binary").alias("t"), F.col(lang).cast("string").alias("l"))
    sums = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = written(sums)
    if (n := sums.select("lang").distinct().count()) > MOST_LANGUAGES:
        raise ValueError(f"{n} labelled languages are more than MOST_LANGUAGES, {MOST_LANGUAGES}")
    if not n:
        return {}
    table = sums.toArrow()  # MOST_LANGUAGES * BUCKETS rows at most
    codes = table.column("lang").combine_chunks().dictionary_encode()
    counts = np.zeros((len(codes.dictionary), BUCKETS))
    counts[codes.indices.to_numpy(), table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return dict(zip(codes.dictionary.to_pylist(), counts, strict=True))


def _emit(own: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for code, n in own.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([code] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])


class Likelihood:
    """Log-likelihoods of texts by language."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.codes = sorted(counts)
        if self.codes:
            n = np.stack([counts[c] for c in self.codes]) + ALPHA
            self.log = np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if not self.codes or not texts:
            return np.zeros((len(texts), len(self.codes)))
        x, at = buckets(texts)
        n = np.diff(np.append(at, len(x)))
        sums = np.stack([np.add.reduceat(row[x], at, dtype=np.float64) for row in self.log], axis=1)
        empty = np.array([not t.translate(_FOLD).strip() for t in texts])
        sums *= (np.minimum(n, EVIDENCE) / n)[:, None]
        sums[empty] = 0
        return sums - sums.max(axis=1, keepdims=True)


def trained(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Likelihood:
    """Likelihoods counted over all labelled rows but those held out."""
    return Likelihood(_counts(labelled.filter(~held_out(F.col(doc_id))), text, lang))


def _evidence(rows: DataFrame, likelihood: Likelihood, markup: bool, carry: list[str]) -> DataFrame:
    model = rows.sparkSession.sparkContext.broadcast(likelihood)

    def make():
        def work(texts):
            plain = [t or b"" for t in texts]
            return {"declared": [declared(t) if markup else None for t in plain], "log_likelihood": list(model.value([visible(t) if markup else t for t in plain]))}

        return work

    return map_texts(rows, "__text", carry, "declared string, log_likelihood array<double>", make)


def _vote(ll: F.Column) -> F.Column:
    """The place, from 0, of the likeliest language of a text, ties to the first; null without evidence."""
    best = F.array_max(ll)
    return F.when(F.array_min(ll) < best, F.array_position(ll, best).cast("int") - 1)


def _numbers(values) -> F.Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _votes_by(votes: DataFrame, keys: list[str], k: int, out: str) -> DataFrame:
    """keys and out, the number of votes of each of the k languages: sums over (keys, language), then k of those a row."""
    counts = votes.groupBy(*keys, "vote").agg(F.sum("n").cast("double").alias("n"))
    by_place = F.map_from_entries(F.collect_list(F.struct("vote", "n")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("__n", i), F.lit(0.0)))
    return counts.groupBy(*keys).agg(by_place.alias("__n")).select(*keys, dense.alias(out))


def _smoothed(counts: F.Column, towards: F.Column, weight: float) -> F.Column:
    """Shares of the counts, with `weight` pseudo-counts dealt as the shares `towards`."""
    total = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x) + weight
    return F.zip_with(counts, towards, lambda n, p: (n + weight * p) / total)


def identified(rows: DataFrame, likelihood: Likelihood) -> DataFrame:
    """Adds lang, probability and text_lang to rows of (any columns), kind, host, domain, suffix, declared, log_likelihood; one row for each.

    Priors are keyed by kind and host, domains (null: none) are joined to hosts and not to rows. Counts are sums over
    (key, language), so a host with a third of all rows is added up in parts, and the table of hosts is written, so
    that Spark splits such a host's rows when it joins them. Declared and address codes have two or three letters:
    their tables have at most 18,252 and 676 rows and are broadcast. Rows without any evidence get the commonest
    language; with no languages at all, null.
    """
    codes = likelihood.codes
    if not codes:
        return rows.select("*", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"))
    k = len(codes)
    given = rows.columns
    rows = rows.withColumn("__vote", _vote(F.col("log_likelihood")))
    votes = rows.filter("__vote is not null").select("kind", "host", "domain", "declared", "suffix", F.col("__vote").alias("vote"), F.lit(1).alias("n"))
    by_host = written(votes.groupBy("kind", "host", "domain", "vote").agg(F.sum("n").alias("n")))
    hosts = _votes_by(by_host, ["kind", "host", "domain"], k, "__host_n")
    domains = _votes_by(by_host.filter("domain is not null"), ["domain"], k, "__domain_n").withColumnRenamed("domain", "__domain")
    domained = hosts.filter("domain is not null").join(domains, F.col("domain") == F.col("__domain")).drop("__domain")
    none = _numbers([0] * k)
    hosts = written(domained.unionByName(hosts.filter("domain is null").withColumn("__domain_n", none)).select(F.col("kind").alias("__kind"), F.col("host").alias("__host"), "__host_n", "__domain_n"))
    overall = np.ones(k)
    for r in by_host.groupBy("vote").agg(F.sum("n").alias("n")).collect():  # k rows
        overall[r.vote] += r.n
    out = rows.join(hosts, (F.col("kind") == F.col("__kind")) & (F.col("host") == F.col("__host")), "left")
    all_n = {}
    for name in ("declared", "suffix"):
        table = written(_votes_by(votes.filter(F.col(name).isNotNull()), [name], k, f"__{name}_n"))
        all_n[name] = [float(x or 0) for x in table.agg(F.array(*[F.sum(F.col(f"__{name}_n")[i]) for i in range(k)])).first()[0]]
        out = out.join(F.broadcast(table.withColumnRenamed(name, f"__{name}")), F.col(name) == F.col(f"__{name}"), "left")
    languages_ = F.array(*[F.lit(c) for c in codes])

    def others(counts: str) -> F.Column:
        """The counts without the row's own vote."""
        return F.transform(F.coalesce(F.col(counts), none), lambda n, i: F.when(i == F.col("__vote"), F.greatest(n - 1, F.lit(0.0))).otherwise(n))

    def signal(name: str) -> F.Column:
        """P(value | language): counted, towards agreement of value and code; a value that no language has says nothing."""
        known = F.array_contains(languages_, F.col(name))
        agrees = F.transform(languages_, lambda c: F.when(c == F.col(name), F.lit(0.9)).when(known, F.lit(0.1 / k)).otherwise(F.lit(0.5)))
        hit = F.zip_with(others(f"__{name}_n"), agrees, lambda n, p: n + SIGNAL * p)
        share = F.zip_with(hit, _numbers(all_n[name]), lambda n, total: n / (total + SIGNAL))
        return F.when(F.col(name).isNull(), _numbers([1] * k)).otherwise(share)

    out = out.withColumn("__prior", _smoothed(others("__host_n"), _smoothed(others("__domain_n"), _numbers(overall / overall.sum()), DOMAIN), HOST))
    for name in ("declared", "suffix"):
        out = out.withColumn("__prior", F.zip_with("__prior", signal(name), lambda p, s: p * s))
    out = out.withColumn("__log", F.zip_with("log_likelihood", "__prior", lambda ll, p: ll + F.log(p))).withColumn("__best", F.array_max("__log"))
    weight = F.aggregate("__log", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("__best")))
    lang = F.element_at(languages_, F.array_position("__log", F.col("__best")).cast("int"))
    return out.select(*given, lang.alias("lang"), (F.lit(1.0) / weight).alias("probability"), F.try_element_at(languages_, F.col("__vote") + 1).alias("text_lang"))


def address_code(url: F.Column) -> F.Column:
    """The language code in an address: a two-letter first path part or first host label, else a two-letter top-level domain; null if none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([A-Za-z]{2})(?:[\-_][A-Za-z]{2})?(?:[/?#]|$)", 1)
    first = F.regexp_extract(host_of(url), r"^([a-z]{2})\.", 1)
    last = F.regexp_extract(host_of(url), r"\.([a-z]{2})$", 1)
    return F.coalesce(*[F.nullif(F.lower(x), F.lit("")) for x in (path, first, last)])


#: Second-level labels under which countries register names, so that a domain has one label more.
REGISTRIES = ("ac", "co", "com", "edu", "gov", "net", "org")


def domain_of(host: F.Column) -> F.Column:
    """The registered name in a host: its last two labels, three under a country's registry label such as co.uk; null if it has no dot."""
    long = F.regexp_extract(host, rf"([^.]+\.(?:{'|'.join(REGISTRIES)})\.[a-z]{{2}})$", 1)
    return F.coalesce(F.nullif(long, F.lit("")), F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")))


def page_evidence(pages: DataFrame, likelihood: Likelihood, carry: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """Carried columns, kind, host, domain, suffix, declared, log_likelihood of pages. Null html has no text and declares nothing; pages with a null url are of one host."""
    host = host_of(F.col(url))
    given = pages.select(*carry, F.lit("page").alias("kind"), host.alias("host"), domain_of(host).alias("domain"), address_code(F.col(url)).alias("suffix"), F.col(html).alias("__text"))
    return _evidence(given, likelihood, True, [*carry, "kind", "host", "domain", "suffix"])


def document_evidence(docs: DataFrame, likelihood: Likelihood, carry: list[str], host: str = "source", text: str = "text") -> DataFrame:
    """The same of plain documents, whose host is their source (null: one of its own)."""
    none = F.lit(None).cast("string")
    source = F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit(""))
    given = docs.select(*carry, F.lit("document").alias("kind"), source.alias("host"), none.alias("domain"), none.alias("suffix"), F.col(text).alias("__text"))
    return _evidence(given, likelihood, False, [*carry, "kind", "host", "domain", "suffix"])


def languages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_id, lang, probability, text_lang, declared, suffix: one row for each document (page_id null) and each page (doc_id null).

    Repeated rows are rows of their own with equal results. Trained on the documents' lang, which is no input of a document's own result beyond the trigram counts.
    """
    likelihood = trained(docs)
    one = document_evidence(docs.withColumn("page_id", F.lit(None).cast("long")), likelihood, ["doc_id", "page_id"])
    two = page_evidence(pages.withColumn("doc_id", F.lit(None).cast("long")), likelihood, ["doc_id", "page_id"])
    found = identified(written(one.unionByName(two)), likelihood)
    return found.select("doc_id", "page_id", "lang", F.round("probability", 6).alias("probability"), "text_lang", "declared", "suffix")
