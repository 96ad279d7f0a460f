import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeel.llm import batchdedup, boilerplate, neardup, repeated, stories, trees
from lorekeel.llm import bytescan as bs
from tests.conftest import rows

SCHEMA = "url string, title string, body string, source string, published timestamp, scraped_at timestamp, document_id string, content_hash string, rid string"
WORDS = [f"w{i}x" for i in range(300)]


def paragraph(r, n=30):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def page(r, story):
    top = ["Home | News | Contact", "By Jane Doe", "Published 2024-01-02 at 10:00"]
    return "\n".join([*top, "", *story, "", "Share this story", "© 2024 Paper. All rights reserved.", "Terms of service | Privacy notice | Accessibility"])


def articles(spark, pages):
    data = [(f"u{i}", p[0], p[1], p[2], None, None, p[3] if len(p) > 3 else f"d{i:04d}", None, "clash") for i, p in enumerate(pages)]
    return spark.createDataFrame(data, SCHEMA).withColumn("scraped_at", F.expr("timestamp_micros(cast(substr(document_id, 2) as bigint) * 1000000)"))


def test_words_and_lines_match_python():
    texts = ["Hello, wörld-42 ÉTÉ", "", "a\n\n b", "«x» “y” Привет ＡＢ", "no break thin"]
    s = bs.scan_words(texts)
    for k, t in enumerate(texts):
        want = re.findall(r"[^\W_]+", t.lower())
        assert int((s.word_text == k).sum()) == len(want)
    same = bs.scan_words(["ÉTÉ ПРИВЕТ", "été привет"])
    assert set(same.word[same.word_text == 0]) == set(same.word[same.word_text == 1])


def test_trees_learn_an_interaction():
    g = np.random.default_rng(0)
    x = g.random((3, 3000)).astype(np.float32)
    y = ((x[0] > 0.5) ^ (x[1] > 0.5)).astype(float)
    assert ((trees.fit(x, y).margin(x) > 0) == (y > 0)).mean() > 0.97
    assert trees.fit(x, np.ones(3000)).margin(x).min() > 0


def test_decoder_keeps_a_block_together():
    got = boilerplate.decode(np.array([3.0, -0.1, 3.0, -4.0, -4.0]), np.array([0, 0, 0, 1, 1]))
    assert got.tolist() == [True, True, True, False, False]
    assert boilerplate.decode(np.array([5.0, -5.0]), np.array([0, 0])).tolist() == [True, False]
    assert boilerplate.decode(np.zeros(0), np.zeros(0, int)).tolist() == []


def test_furniture_is_told_from_story(spark):
    r = random.Random(1)
    pages = [("T", page(r, [paragraph(r) for _ in range(4)]), "s") for _ in range(60)]
    got = {(a, b) for a, b in rows(boilerplate.boilerplate_lines(articles(spark, pages)))}
    assert got == {(f"d{i:04d}", k) for i in range(60) for k in (0, 1, 2, 9, 10, 11)}


def test_pages_with_nulls_and_none_at_all(spark):
    a = articles(spark, [(None, None, "s"), ("t", "", None), (None, "\n \n", "s")])
    assert rows(boilerplate.boilerplate_lines(a)) == [] and rows(boilerplate.boilerplate_lines(a.limit(0))) == []
    assert [x[1] for x in rows(boilerplate.main_text(a))] == ["", "", ""]


def brute_lines(pages):
    form = lambda x: re.sub(r"\d+", "0", " ".join(x.lower().split()))
    out, per = [], {}
    for i, p in enumerate(pages):
        for k, line in enumerate((p[1] or "").split("\n")):
            if form(line):
                per.setdefault((p[2], form(line)), set()).add(i)
                out.append((i, k, p[2], form(line)))
    size = {s: sum(p[2] == s for p in pages) for s in {p[2] for p in pages}}
    ok = {k for k, v in per.items() if len(v) >= 5 and len(v) * 20 >= size[k[0]]}
    return sorted((f"d{i:04d}", k) for i, k, s, f in out if (s, f) in ok)


def test_repeated_lines_against_brute_force(spark):
    r = random.Random(2)
    common = ["Share  this 12 times", "\tSHARE this 7 times ", "A long legal notice number 1234 that goes on and on for a hundred characters, or a little more than that, indeed.", "x"]
    pages = []
    for _ in range(150):
        lines = [paragraph(r, 12), r.choice(common), paragraph(r, 5) + " " + r.choice(common), "", r.choice(common)]
        pages.append(("t", "\n".join(lines), r.choice(["hot", "hot", "hot", "b", None])))
    pages += [("t", None, "hot"), ("t", "", "b")]
    a = articles(spark, pages).repartition(4)
    assert rows(repeated.repeated_lines(a)) == brute_lines(pages)
    assert rows(repeated.repeated_lines(a.limit(0))) == []
    cut = repeated.without_lines(a, repeated.repeated_lines(a))
    assert cut.count() == len(pages) and cut.columns == a.columns


def variants(r, base, n):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(3):
            words[r.randrange(len(words))] = r.choice(WORDS)
        out.append(" ".join(words))
    return out


def near_fixture(spark, r):
    texts = [" ".join(r.choice(WORDS) for _ in range(r.choice([4, 20, 60, 90]))) for _ in range(60)]
    texts += variants(r, texts[3] + " " + texts[4] + " " + texts[5], 12) + [texts[0]] * 15 + ["a b", "", "one two three", "one two three"]
    words = {i: bs.scan_words([t]).word for i, t in enumerate(texts)}
    data = [(i, f"d{i:04d}", i, (w >> bs.U64(32)).astype(stories.WORD).tobytes()) for i, w in words.items() if len(w) >= 3]
    return texts, spark.createDataFrame(data, "rid long, document_id string, at long, words binary").withColumn("scraped_at", F.col("at")).withColumn("key", F.md5("words").cast("binary"))


def brute_near(texts, least=0.5):
    sets = {}
    for i, t in enumerate(texts):
        w = t.split()
        if len(w) >= 3:
            sets[i] = set(zip(w, w[1:], w[2:], strict=False))
    return sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))


def test_t_occurrence_against_brute_force(spark, monkeypatch):
    texts, table = near_fixture(spark, random.Random(3))
    want = brute_near(texts)
    assert sorted((r["a"], r["b"]) for r in neardup.similar_classes(table).collect()) == want
    monkeypatch.setattr(neardup, "hot_shingles", lambda t, n, k: np.unique(np.concatenate([stories.shingles(np.frombuffer(r["words"], stories.WORD), np.array([len(r["words"]) // 4]))[1] for r in t.collect()])))
    assert sorted((r["a"], r["b"]) for r in neardup.similar_classes(table).collect()) == want  # every list treated as hot
    monkeypatch.undo()
    assert neardup.similar_classes(table.limit(0)).count() == 0


def test_segments_search_and_merge():
    g = np.random.default_rng(4)
    seg, seen = batchdedup.Segments(), {}
    for batch in range(60):
        key = np.sort(g.integers(0, 50, 9)).astype(np.uint64) << np.uint64(32)
        first, last, depth = seg.search(key, 10**6)
        assert ((depth < 3) == [k in seen for k in key.tolist()]).all()
        for k, f, x in zip(key.tolist(), first.tolist(), last.tolist(), strict=True):
            assert (f, x) == ((seen[k][0], seen[k][-1]) if k in seen else (10**6, -1))
        seg.add(batchdedup.SuffixArray.of(key, np.full(9, batch)))
        for k in key.tolist():
            seen.setdefault(k, []).append(batch)
    assert len(seg.held) <= 8


def test_first_known_equals_the_earliest_near_article(spark):
    r = random.Random(6)
    base = [[paragraph(r) for _ in range(4)] for _ in range(12)]
    pages = []
    for k in range(40):
        story = list(r.choice(base))
        if r.random() < 0.7:
            i = r.randrange(4)
            words = story[i].split()
            words[r.randrange(len(words))] = r.choice(WORDS)
            story[i] = " ".join(words)
        pages.append(("t", page(r, story), "s"))
    pages += [("t", None, "s"), ("t", "", "s")]
    a = articles(spark, pages)
    pairs = rows(neardup.near_duplicate_pairs(a))
    want = {}
    for x, y in pairs:
        want[y] = min(want.get(y, x), x)
    assert dict(rows(batchdedup.first_known(a))) == want and len(want) > 20
    groups = neardup.near_duplicate_groups(a)
    assert groups.count() == 40


def test_index_gives_batch_by_batch_what_the_whole_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batchdedup, "FAN_IN", 2)
    r = random.Random(7)
    base = [[paragraph(r) for _ in range(4)] for _ in range(6)]
    pages = []
    for _ in range(40):
        story = list(r.choice(base))
        if r.random() < 0.6:
            i = r.randrange(4)
            words = story[i].split()
            words[r.randrange(len(words))] = r.choice(WORDS)
            story[i] = " ".join(words)
        pages.append(("t", page(r, story), "s"))
    a = articles(spark, pages)
    whole = dict(rows(batchdedup.first_known(a)))
    index, got = batchdedup.HistoryIndex(spark, str(tmp_path / "index"), 4), {}
    for lo in range(0, 40, 10):
        part = a.where((F.substring("document_id", 2, 9).cast("int") >= lo) & (F.substring("document_id", 2, 9).cast("int") < lo + 10))
        got |= dict(rows(index.add(part)))
    assert got == whole and len(index._manifest()["segments"]) == 1


def test_longest_match_goes_first():
    old = batchdedup.SuffixArray.of(np.array([0x500010001, 0x500010002, 0x500020001, 0x600010001], np.uint64), np.array([3, 1, 0, 2]))
    seg = batchdedup.Segments()
    seg.add(old)
    first, last, depth = seg.search(np.array([0x500010001, 0x500010009, 0x500090009, 0x700000000], np.uint64), 9)
    assert first.tolist() == [3, 1, 0, 9] and last.tolist() == [3, 3, 3, -1] and depth.tolist() == [0, 1, 2, 3]


@pytest.mark.parametrize("every", [9, 10])
def test_batches_find_scattered_edits(spark, every):
    """Pairs that differ in every ninth or tenth word, similarity about one half, among other texts."""
    r = random.Random(every)
    word = lambda: f"w{r.randrange(30_000)}"
    size = lambda: r.choice([12, 30, 70, 200])
    made = []
    for k in range(200):
        one = [word() for _ in range(size())]
        shift = r.randrange(every)
        made.append((2 * k, one))
        made.append((2 * k + 1, [word() if i % every == shift else x for i, x in enumerate(one)]))
    hashes = {}
    packed = lambda t: np.array([hashes.setdefault(x, r.randrange(1 << 32)) for x in t], np.uint32).tobytes()
    table = spark.createDataFrame([(i, i, f"{i:09d}", packed(t)) for i, t in made], "rid long, at long, document_id string, words binary")
    found = {(min(x), max(x)) for x in rows(batchdedup.covered_pairs(table))}
    grams = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    near = {(2 * k, 2 * k + 1) for k in range(200) for a, b in ((grams(made[2 * k][1]), grams(made[2 * k + 1][1])),) if len(a & b) >= 0.5 * len(a | b)}
    assert near <= found and len(near) > 60
    assert len(found - {(2 * k, 2 * k + 1) for k in range(200)}) < 10


def test_first_known_finds_pairs_that_share_few_of_their_words(spark, monkeypatch):
    """Stories that differ in a long run of the same words, so that most runs of three words but few words are shared."""
    r = random.Random(3)
    new = lambda n: [r.randrange(1 << 32) for _ in range(n)]
    same, other = new(100), new(100)
    told = [same + new(3) * 400, other + new(3) * 300, same + new(3) * 500, new(80), other + new(3) * 400]
    made = [(i, f"{i:03d}", i, str(i).encode(), np.array(t, np.uint32).tobytes()) for i, t in enumerate(told)]
    table = spark.createDataFrame(made, "rid long, document_id string, scraped_at long, key binary, words binary")
    monkeypatch.setattr(stories, "story_words", lambda x: x)
    assert rows(batchdedup.first_known(table)) == [("002", "000"), ("004", "001")]
