import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.common import Words
from weftline.llm.line_rules import TABLE, cleaned, line_hash, repeated_words, verdicts, without_lines

S = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = S.findall(text or "")
    dup, seen = 0, set()
    for line in (text or "").split("\n"):
        dup += bool(S.search(line)) and line in seen
        seen.add(line)
    times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é漢#|\n\t", max_size=60), max_size=4))
def test_repeated_words(texts):
    assert repeated_words(Words([t.encode() for t in texts], TABLE)).tolist() == [plain(t)[4] for t in texts]


def test_base_measures(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in verdicts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), ["doc_id"]).collect():
        want = plain(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)


def name(i):
    """Letters for a number: digits are alike in a normalised line."""
    return "".join(chr(97 + int(c)) for c in str(i))


def lines_of(i, n):
    return "\n".join(" ".join(f"{i}{'abcdefghi'[j]}{'abcdefghi'[k]}" for k in range(9)) for j in range(n))


def corpus():
    """Thirty documents of a host with one line in common, some of which hold little more, and thirty copies of one text."""
    line = "Subscribe to our  letter NOW and never miss a word of it again"
    rows = [(i, f"{line.upper() if i % 2 else line}\n{lines_of(name(i), 5)}", "h") for i in range(30)]
    rows += [(100 + i, f"{line}\nfew words left {name(i)}", "h") for i in range(4)]
    rows += [(200 + i, lines_of("copy", 6), "h") for i in range(30)] + [(300 + i, f"{lines_of('near', 6)}\nedit {name(i)} here", "h") for i in range(20)]
    return rows + [(400, f"{line}\n{lines_of('o', 3)}", "other")], line


def test_frequent_lines_and_depleted_documents(spark):
    rows, line = corpus()
    got = {r.doc_id: r for r in verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()}
    assert all(got[i].removed == [line_hash(line.encode())] and got[i].kept for i in range(30))
    assert all(got[100 + i].removed_words == 13 and not got[100 + i].kept and not got[100 + i].base_failed for i in range(4))
    assert all(got[i].kept and not got[i].removed for i in (*range(200, 230), *range(300, 320), 400))  # equal texts count once, 20 are no more than the limit, hosts are apart


def test_lines_that_go_together_do_not_hide_each_other(spark):
    """Two long passages and a menu that many documents of one host share, beside short lines of their own."""
    a, b = " ".join(f"a{name(i)}" for i in range(60)), " ".join(f"b{name(i)}" for i in range(55))
    rows = [(i, f"{a}\nHome About\n{b}\n{lines_of('own' + name(i), 9)}", "h") for i in range(3000)]
    got = verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()
    assert {r.removed_words for r in got} == {117} and all(r.kept for r in got)


def test_documents_are_counted_as_a_loop_counts_them(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, "\n".join(f"line {name(rnd.randrange(40) ** 2 // 40)} of words" for _ in range(rnd.randrange(1, 12))), rnd.choice(["a", "b", None])) for i in range(300)] + [(300 + i, "x", "b") for i in range(9)]
    rows += rows[:50]
    documents = {}
    for _, t, host in rows:
        for x in set(map(line_hash, t.encode().split(b"\n"))):
            documents.setdefault((host, x), set()).add(t)
    for r in verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id", "text", "source"], least=9).collect():
        lines = [(line_hash(x.encode()), len(x.split())) for x in r.text.split("\n")]
        gone = {h for h, _ in lines if len(documents[r.source, h]) > 9}
        assert set(r.removed) == gone and r.removed_words == sum(n for h, n in lines if h in gone)


def test_cleaned_texts_agree_with_verdicts(spark, monkeypatch):
    from weftline.llm import line_rules

    rows, _ = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = verdicts(df, ["doc_id", "text"]).collect()
    want = sorted((r.doc_id, without_lines(r.text.encode(), set(r.removed)).decode()) for r in judged if r.kept)
    assert sorted((r.doc_id, r.text) for r in cleaned(df).collect()) == want
    monkeypatch.setattr(line_rules, "BROADCAST_LINES", 0)
    assert sorted((r.doc_id, r.text) for r in cleaned(df).collect()) == want


def test_odd_and_empty_tables(odd, empty, odd_rows):
    got = verdicts(odd, ["doc_id"]).collect()
    assert len(got) == len(odd_rows)
    assert sum(r.kept for r in got) == sum(plain(r[1])[0] >= 10 and 100 * plain(r[1])[4] <= 20 * plain(r[1])[0] for r in odd_rows)
    assert {r.n_words for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert cleaned(odd).columns == odd.columns and cleaned(odd).count() == sum(r.kept for r in got)
    assert verdicts(empty, ["doc_id"]).count() == cleaned(empty).count() == 0
