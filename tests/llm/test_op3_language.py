import zlib

import numpy as np

from weftline.llm.language import Likelihood, address_code, document_evidence, identified, languages, page_evidence, trained, visible


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, pages = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/pages.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = languages(docs, pages).collect()
    held = [r for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(rows) == 1250 and np.mean([r.lang == truth[r.doc_id] for r in held]) > 0.98
    on_pages = [r for r in rows if r.page_id is not None]
    assert np.mean([r.lang == r.declared for r in on_pages]) > 0.98


def test_likelihood_is_the_plain_sum():
    counts = {"x": np.zeros(1 << 15), "y": np.zeros(1 << 15)}
    from weftline.llm.language import EVIDENCE, buckets

    for code, text in (("x", b"abc abc abd"), ("y", b"xyz xyz")):
        counts[code] += np.bincount(buckets([text])[0], minlength=1 << 15)
    got = Likelihood(counts)([b"abc", b"xyz", b"", b"12"])
    assert got[0, 0] == 0 > got[0, 1] and got[1, 1] == 0 > got[1, 0] and not got[2:].any()
    n = {k: v + 0.5 for k, v in counts.items()}
    x = buckets([b"abc"])[0]
    plain = [np.log(n[k][x] / n[k].sum()).sum() * min(len(x), EVIDENCE) / len(x) for k in "xy"]
    assert np.allclose(got[0], np.array(plain) - max(plain), atol=1e-4)


def test_evidence_decides_what_texts_leave_open(spark):
    docs = spark.createDataFrame([(i, t, c, "s", 0) for i in range(40) for t, c in ((f"the house and the dog {i}", "en"), (f"das haus und der hund {i}", "de"))], "doc_id long, text string, lang string, source string, n_chars long")
    model = trained(docs)
    page = lambda text, lang="": f'<html lang="{lang}"><body><p>{text}</p></body></html>' if lang else f"<html><p>{text}</p></html>"
    rows = [(i, f"http://a.example.com/{i}", page("der hund und das haus")) for i in range(20)] + [(i, f"http://b.example.org/{i}", page("the dog and the house", "en")) for i in range(20, 40)]
    rows += [(100, "http://a.example.com/x", page("12 34")), (101, "http://b.example.org/x", page("")), (102, "http://c.example.org/x", page("12", "de")), (103, None, None), (104, "http://new.example.com/y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.lang for r in identified(page_evidence(pages, model, ["page_id"]), model).collect()}
    assert got[0] == "de" and got[20] == "en"
    assert got[100] == "de" and got[101] == "en"  # the host
    assert got[104] == "de"  # its domain
    assert got[103] in ("de", "en")


def test_address_codes(spark):
    urls = ["http://x.com/fr/a", "http://x.com/fr-CA", "https://de.x.com/", "https://x.es/abc", "https://x.com/abc", None, "nonsense"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(address_code(F.col("u"))).collect()] == ["fr", "fr", "de", "es", None, None, None]


def test_visible_text():
    assert visible(b"a<script>x</script><!-- b -->c&amp;<b>d</b>").split() == [b"a", b"c", b"d"]


def test_odd_and_empty_tables(spark, odd, empty, odd_rows):
    pages = spark.createDataFrame([(None, None, None), (1, "", ""), (1, "", "")], "page_id long, url string, html string")
    rows = languages(odd, pages).collect()
    assert len(rows) == len(odd_rows) + 3 and all(r.lang for r in rows)
    assert languages(empty, pages.limit(0)).count() == 0
    assert [r.lang for r in languages(empty, pages).collect()] == [None] * 3
    assert document_evidence(odd, trained(odd), ["doc_id"]).count() == len(odd_rows)


def test_declared_language_anywhere_in_a_page():
    from weftline.llm.language import declared

    late = b"<!-- " + b"licence " * 1000 + b"-->\n"
    assert declared(late + b'<html class="a" lang="de-AT"><body>x') == "de"
    assert declared(b'<html data-x="' + b"y" * 5000 + b'" xml:lang=fr>') == "fr"
    assert declared(b'<!--[if IE]><html lang="en"><![endif]--><html lang="es">') == "es"
    assert declared(b"<html lang=\"pt><body>x") == "pt"
    assert declared(b"<html><p>say &lt;html> <html lang='en'>") is None and declared(b"") is None


def fused(rows, codes):
    """The posterior of each row (kind, host, domain, declared, suffix, log-likelihoods) in plain loops."""
    k = len(codes)
    votes = [int(np.argmax(r[5])) if min(r[5]) < max(r[5]) else None for r in rows]
    overall = [1 + votes.count(i) for i in range(k)]
    out = []
    for r, own in zip(rows, votes, strict=True):
        others = [(q, v) for j, (q, v) in enumerate(zip(rows, votes, strict=True)) if v is not None and q is not r]
        p = [n / sum(overall) for n in overall]
        for weight, same in ((8, lambda q: r[2] is not None and (q[0], q[2]) == (r[0], r[2])), (4, lambda q: q[:2] == r[:2])):
            n = [sum(v == i for q, v in others if same(q)) for i in range(k)]
            p = [(n[i] + weight * p[i]) / (sum(n) + weight) for i in range(k)]
        for at in (3, 4):
            if r[at] is not None:
                agrees = [0.9 if r[at] == c else 0.1 / k if r[at] in codes else 0.5 for c in codes]
                total = [sum(v == i for q, v in zip(rows, votes, strict=True) if q[at] is not None) for i in range(k)]
                p = [p[i] * (sum(v == i for q, v in others if q[at] == r[at]) + 2 * agrees[i]) / (total[i] + 2) for i in range(k)]
        z = np.array([r[5][i] + np.log(p[i]) for i in range(k)])
        out.append((codes[int(np.argmax(z))], float(1 / np.exp(z - z.max()).sum()), None if own is None else codes[own]))
    return out


def test_the_posterior_is_that_of_plain_loops(spark):
    import random

    rnd = random.Random(5)
    codes = ["de", "en", "fr"]
    rows = []
    for _ in range(120):
        page = rnd.random() < 0.6
        host = rnd.choice(["a.x.com", "b.x.com", "c.y.org", ""]) if page else rnd.choice(["=a.x.com", "=s", ""])
        ll = [0.0] * 3 if rnd.random() < 0.2 else [-rnd.random() * 5 for _ in codes]
        rows.append(("page" if page else "document", host, host[2:] or None if page else None, rnd.choice([None, "de", "en", "xx"]) if page else None, rnd.choice([None, "fr", "zz"]) if page else None, ll))
    rows += [(*r[:5], list(r[5])) for r in rows[:20]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at long, kind string, host string, domain string, declared string, suffix string, log_likelihood array<double>")
    model = Likelihood({c: np.ones(1 << 15) for c in codes})
    got = {r.at: r for r in identified(df, model).collect()}
    assert len(got) == len(rows) == identified(df, model).count()
    for i, (lang, probability, vote) in enumerate(fused(rows, codes)):
        assert got[i].lang == lang and abs(got[i].probability - probability) < 1e-9 and got[i].text_lang == vote


def test_a_source_may_be_named_like_a_host(spark):
    docs = spark.createDataFrame([(i, f"the house and the dog {i}", "en", "site.example.com", 0) for i in range(10)], "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([(i, f"http://site.example.com/{i}", "<p>the dog and the house</p>") for i in range(6)] * 2, "page_id long, url string, html string")
    rows = languages(docs, pages).collect()
    assert len(rows) == 22 and len([r for r in rows if r.doc_id is not None]) == 10


def test_no_languages_are_left_out(spark, monkeypatch):
    import pytest

    from weftline.llm import language

    codes = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrstuvwxyz"] + [f"{a}{b}x" for a in "abcdefgh" for b in "klmnopqrst"]
    docs = spark.createDataFrame([(i, f"{c * 4} {c[::-1] * 5} zz", c, "s", 0) for i, c in enumerate(codes * 3)], "doc_id long, text string, lang string, source string, n_chars long")
    model = trained(docs)
    assert set(model.codes) == set(codes) and len(codes) == 240
    got = identified(document_evidence(docs, model, ["doc_id", "lang"]).withColumnRenamed("lang", "truth"), model).select("truth", "lang").collect()
    assert np.mean([r.truth == r.lang for r in got]) > 0.9
    monkeypatch.setattr(language, "MOST_LANGUAGES", 239)
    with pytest.raises(ValueError, match="240"):
        trained(docs)


def test_hosts_and_domains(spark):
    from pyspark.sql import functions as F

    from weftline.llm.language import domain_of

    hosts = ["www.a.co.uk", "a.co.uk", "b.example.com", "example.com", "localhost", ""]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, h string")
    assert [r[0] for r in df.orderBy("i").select(domain_of(F.col("h"))).collect()] == ["a.co.uk", "a.co.uk", "example.com", "example.com", None, None]
