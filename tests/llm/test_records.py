import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeel.llm import groups, leakage, lookalike, mixing, namejoin, names
from tests.conftest import rows

E = "entity_id string, canonical_name string, entity_type string, merged_into string"
P = "prov_id long, entity_id string, mention_text string"


def brute_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((x, find(x)) for x in parent)


@pytest.mark.parametrize("bound", [5, 10**6])
def test_components_against_brute_force(spark, bound):
    r = random.Random(bound)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(0, k) for k in range(200, 260)] + [(i, i + 1) for i in range(300, 340)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(rows(groups.components(df, bound))) == brute_components(edges)
    assert rows(groups.components(df.limit(0), bound)) == []


def test_entity_groups_run_through_unknown_ids(spark):
    e = spark.createDataFrame([("a", "A", "person", "zz"), ("b", "B", "person", None), ("c", "C", "person", "c"), ("d", "D", "person", "gone")], E)
    m = spark.createDataFrame([("zz", "b"), ("b", "zz"), (None, "b"), ("x", "y")], "left_id string, right_id string")
    assert rows(groups.entity_groups(e, m)) == [("a", "a"), ("b", "a")]


def test_tokens_and_edits():
    assert names.tokens("Dr. Élodie O'Hara-Smith") == ["elodie", "ohara", "smith"]
    assert names.tokens("The Foo Bar A.G.") == ["foo", "bar", "ag"] and names.tokens("X Gesellschaft mbH") == ["x", "gmbh"]
    assert names.tokens("A.M. Klee") == ["a", "m", "klee"] and names.tokens("") == []
    for a, b, d in (("abcd", "abdc", 1), ("abc", "axc", 1), ("abc", "abcd", 1), ("abc", "xyz", 3), ("same", "same", 0), ("kitten", "sitting", 3)):
        assert names.edits(a, b, 2) == d


def test_mentions_find_their_entity(spark):
    e = [("1", "Matthias Pamikuvey", "person", None), ("2", "Stegolux Lenalux Telecom Incorporated", "organization", None), ("3", "Lenalux Telecom", "organization", "2"), ("4", "Port Foo", "place", None), ("5", "Gorod Mabibor Telecom Incorporated", "organization", None), ("6", "Loop", "person", "7"), ("7", "Loop", "person", "6")]
    e += [(f"f{i}", f"Matthias Zon{i}grelm", "person", None) for i in range(30)]
    e += [(f"g{i}", f"Zor{i}bamix Kel{i}datan Incorporated", "organization", None) for i in range(40)]
    aliases = spark.createDataFrame([("1", "Matt Pamikuvey"), ("f1", "Matt Zon1grelm"), ("f2", "Matt Zon2grelm"), ("9", "nobody"), ("1", None)], "entity_id string, alias string")
    mentions = ["Pamikuvey, M.", "PAMIKUVEY Matthias", "Matthias Pamikvuey", "MatthiasPamikuvey", "Stegolux & Lenalux Telecom Inc", "Telecom Stegolux Lenalux", "Stegolux L. Telecom", "Matthias Qubalor", "Gorgon Telecom", "Port Foo", "Loop", "", None, "Matt Pamiikuvey"]
    p = spark.createDataFrame([(i, None, m) for i, m in enumerate(mentions)] + [(0, None, mentions[0]), (99, "1", "Matt Pamikuvey")], P)
    got = dict(rows(names.link_mentions(p, spark.createDataFrame(e, E), aliases)))
    assert got == {0: "1", 1: "1", 2: "1", 3: "1", 4: "2", 5: "2", 6: "2", 13: "1"}
    assert names.link_mentions(p.limit(0), spark.createDataFrame([], E), aliases.limit(0)).count() == 0


def test_shapes():
    same = [("ﬁn​al", "final"), ("ＡＢ１", "AB1"), ("été", "été"), ("соре", "cope"), ("a b", "a b"), ("x‑y", "x-y"), ("ё", "ё")]
    for a, b in same:
        assert lookalike.shape(a) == lookalike.shape(b)
    for a, b in (("A", "a"), ("é", "e"), ("a b", "a  b"), ("a\nb", "a b"), ("m²", "m2"), ("l", "I")):
        assert lookalike.shape(a) != lookalike.shape(b)


def test_trie_costs_and_canonical_text():
    c = lookalike.Canon(["привет", "мир"])
    assert c.text("пpивет, миp!") == "привет, мир!" and c.text(None) is None and c.text("plain") == "plain"
    assert c.text("cop​e") == "cope"
    t = lookalike.Trie()
    for w in ("grain", "train"):
        t.add(w)
    assert t.search("grаin") == "grain" and t.search("grin") is None and t.search("grin", 1) == "grain" and t.search("xrain", 1) == "grain"


def test_lookalike_pairs(spark):
    d = spark.createDataFrame([(1, "the final word"), (2, "the ﬁnal word"), (3, "the final word"), (4, "The final word"), (5, None), (6, "thе final word")], "doc_id long, text string")
    assert rows(lookalike.lookalike_pairs(d)) == [(1, 2), (1, 6), (2, 3), (2, 6), (3, 6)]
    assert rows(lookalike.lookalike_pairs(d.limit(0))) == []


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    words = [f"word{i}" for i in range(400)]
    prompt = [" ".join(r.choice(words) for _ in range(40)) for _ in range(6)]
    texts = [" ".join(r.choice(words) for _ in range(80)) for _ in range(30)]
    for i in range(12):
        w = prompt[i % 6].split()
        a = r.randrange(20)
        n = r.choice([12, 13, 20])
        texts[i] = texts[i] + " " + ", ".join(w[a : a + n]).upper() + " " + texts[i][:50]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(98, None), (99, "")], "doc_id long, text string")
    q = spark.createDataFrame([(i, p, "x") for i, p in enumerate(prompt)] + [(7, None, None), (8, "short", "x")], "item_id long, prompt string, answer string")
    grams = lambda t: {tuple(w[k : k + 13]) for w in [t.lower().replace(",", "").split()] for k in range(len(w) - 12)}
    want = sorted((j, i) for j, p in enumerate(prompt) for i, t in enumerate(texts) if grams(p) & grams(t))
    assert rows(leakage.leaked_runs(d, q)) == want and want
    found = {(x, y) for x, y, *_ in rows(leakage.paraphrases(d, q, cosine=0.6, common=0.5))}
    assert found and found <= {(j, i) for j in range(6) for i in range(30)}
    assert rows(leakage.leaked_runs(d.limit(0), q)) == [] and rows(leakage.leaked_runs(d, q.limit(0))) == []


def test_lcs():
    x, y = np.array([[1, 2, 3, 4]]), np.array([[2, 9, 3, 4]])
    assert leakage.lcs_lengths(x, y).tolist() == [3]


def test_mixture_meets_its_shares(spark):
    r = random.Random(9)
    docs = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(5, 60))), "hot" if i % 3 else r.choice("ab")) for i in range(900)] + [(9001, None, "a"), (9002, "x", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("hot", 0.2, 1), ("a", 0.5, 3), ("b", 0.2, 2), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mixture(d, t)
    got = {x["source"]: x for x in shares.collect()}
    assert got["none"]["tokens"] == 0 and all(abs(got[s]["actual_share"] - w / 0.9) < 0.01 for s, w in (("hot", 0.2), ("a", 0.5), ("b", 0.2)))
    copies = Counter()
    for x in mix.collect():
        copies[x["source"]] = max(copies[x["source"]], x["copies"])
    assert copies["hot"] <= 1 and copies["a"] <= 3 and copies["b"] <= 2
    small = {x["doc_id"] for x in mixing.mixture(d, t, 3000)[0].where("source = 'hot'").collect()}
    large = {x["doc_id"] for x in mixing.mixture(d, t, 9000)[0].where("source = 'hot'").collect()}
    assert small < large  # nested
    assert mixing.mixture(d.limit(0), t)[0].count() == 0


def test_long_text_is_counted_whole(spark):
    enc = mixing.encoder()
    text = ("lorem ipsum dolor " * 4000).strip()
    d = spark.createDataFrame([(1, text, "s"), (2, "", "s")], "doc_id long, text string, source string")
    assert [(x["doc_id"], x["tokens"]) for x in mixing.token_counts(d).orderBy("doc_id").collect()] == [(1, len(enc.encode_ordinary(text))), (2, 0)]


def test_similar_tokens_against_brute_force(spark):
    r = random.Random(3)
    words = ["anna", "amna", "smith", "smyth", "weber", "weer", "martin", "matrin", "ann", "an", "abcdefgh", "bacdefxh", "lü", "lüne", "line"]
    words += ["".join(r.choice("abc") for _ in range(r.randrange(2, 12))) for _ in range(300)]
    words = sorted(set(words))
    df = spark.createDataFrame([(w,) for w in words], "key string")
    for most in (1, 2):
        near = lambda a, b: names.edits(a, b, k := min(most, 0 if (n := max(len(a), len(b))) < 4 else 1 if n < 7 else 2)) <= k  # noqa: B023, E731
        want = sorted((a, b) for a in words for b in words if a != b and near(a, b))
        assert rows(names.similar_tokens(df, df, most)) == want and ("anna", "amna") in want


def test_mentions_miss_no_name_that_the_scorer_accepts(spark):
    e = [("1", "Margaret Tolnibar", "person", None), ("2", "Kelvo Industries", "organization", None), ("3", "Anna Robinetal", "person", None), ("4", "Weber Holdings Palimor", "organization", None), ("5", "W. Qestamar", "person", None)]
    e += [(f"a{i}", f"Xu{i}rem Tolnibar", "person", None) for i in range(30)] + [(f"b{i}", f"Zet{i}kan Industries", "organization", None) for i in range(30)]
    e += [(f"c{i}", f"Dor{i}vel Robinetal", "person", None) for i in range(30)] + [(f"d{i}", f"Margaret Vel{i}sotar", "person", None) for i in range(3)]
    aliases = [("d0", "M. Vel0sotar"), ("4", "WeberHoldings Palimor")]
    known = [(100 + i, f"d{i}", f"Peggy Vel{i}sotar") for i in range(3)]  # the nickname stands in resolved mentions only
    mentions = ["Peggy Tolnibar", "Kelvo Indrs", "Amna Robinetal", "Weer Holdings Palimor", "Walter Qestamar", "Tolnibar M.", "WeberHoldngs Palimor", "Kel vo Industries", "Peggyy Tolnibar", "Industries", "Nobody Elsewhere"]
    p = spark.createDataFrame([(i, None, m) for i, m in enumerate(mentions)] + known, P)
    got = dict(rows(names.link_mentions(p, spark.createDataFrame(e, E), spark.createDataFrame(aliases, "entity_id string, alias string"))))
    # All mentions against all names.
    all_names = [(i, n) for i, n, *_ in e] + aliases
    seen = Counter(t for t, _ in {(t, i) for i, n in all_names for t in names.tokens(n)})
    weight = lambda t: float(np.log((len(e) + 1) / (seen[t] + 0.5)))
    forms = {tuple(r) for r in names.short_forms(spark.createDataFrame([(m, dict(all_names[: len(e)])[i], i) for _, i, m in known] + [(a, dict(all_names[: len(e)])[i], i) for i, a in aliases], "text string, name string, target string")).collect()}
    scorer = names.Scorer(forms, float(np.log((len(e) + 1) / (0.002 * len(e) + 8.5))))
    want = {}
    for k, m in enumerate(mentions):
        t = names.tokens(m)
        score = {i: round(s, 6) for s, i in sorted((scorer.score(t, [weight(x) for x in t], r, [weight(x) for x in r]), i) for i, r in ((i, names.tokens(n)) for i, n in all_names))}
        if (best := max(score.values())) >= names.ACCEPT:
            want[k] = min(i for i, s in score.items() if s == best)
    assert got == want and {0: "1", 1: "2", 2: "3"}.items() <= want.items()


def test_paraphrases_of_short_texts_and_at_ends(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    prompts = [text(9), text(24), text(30), text(14), text(35)]
    swapped = lambda p: [x if k % 8 != 5 else r.choice(words) for k, x in enumerate(p)]
    docs = [text(27) + swapped(prompts[0]), text(35) + swapped(prompts[1]), text(23) + swapped(prompts[2])[6:], swapped(prompts[3]), text(31) + swapped(prompts[4])[-24:], swapped(prompts[4][7:20])] + [text(60) for _ in range(40)]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)] + [(98, None), (99, "")], "doc_id long, text string")
    q = spark.createDataFrame([(i, " ".join(p), "") for i, p in enumerate(prompts)], "item_id long, prompt string, answer string")
    assert {(x, y) for x, y, *_ in rows(leakage.paraphrases(d, q))} == {(i, i) for i in range(5)} | {(4, 5)}


def test_paraphrase_recall_against_brute_force(spark):
    """Planted paraphrases, and all pairs of windows that a search over all would find."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(1500)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    prompts = [text(r.randrange(24, 60)) for _ in range(60)]

    def reworded(p):
        out = [x if r.random() > 0.12 else r.choice(words) for x in p]
        return out[: len(out) // 2] + [r.choice(words)] + out[len(out) // 2 :]

    docs = [text(r.randrange(20, 90)) + reworded(p) + text(r.randrange(20, 90)) for p in prompts] + [text(150) for _ in range(60)]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    q = spark.createDataFrame([(i, " ".join(p), "") for i, p in enumerate(prompts)], "item_id long, prompt string, answer string")
    space = leakage.fit(d)
    found = {(x, y) for x, y, *_ in rows(leakage.paraphrases(d, q, space=space))}
    assert len([i for i in range(60) if (i, i) in found]) >= 54 and all(x == y for x, y in found)
    # The index against all pairs of windows.
    w, size = leakage._scan([" ".join(p) for p in prompts])
    v, n = leakage._scan([" ".join(t) for t in docs])
    f, g = leakage.spans(size, 24, 6)[1], leakage.spans(n, 24, 12)[1]
    a, b = leakage._sums(space, w), leakage._sums(space, v)
    mine, item = b[g + 24] - b[g], a[f + 24] - a[f]
    near = leakage._unit(mine) @ leakage._unit(item).T >= 0.8
    i, j, _ = leakage.Cells(item).near(mine, 0.8)
    assert near[i, j].all() and len(set(zip(i.tolist(), j.tolist()))) == len(i) == near.sum() > 30
    # Without the latent space nothing is met.
    none = leakage.Space(np.zeros_like(space.terms), space.energy)
    assert rows(leakage.leaked_runs(d, q, space=none)) == []


def test_runs_of_thirteen_at_every_place(spark):
    r = random.Random(5)
    words = [f"v{i}" for i in range(900)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    prompt = text(45)
    docs = []
    for k in range(60):
        n, at = (13, 12)[k % 2], r.randrange(0, 33)
        docs.append(text(r.randrange(0, 30)) + prompt[at : at + n] + text(r.randrange(0, 30)))
    runs = {tuple(prompt[i : i + 13]) for i in range(33)}
    want = [(7, k) for k, t in enumerate(docs) if any(tuple(t[i : i + 13]) in runs for i in range(len(t) - 12))]
    assert 30 <= len(want) < 40
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    q = spark.createDataFrame([(7, " ".join(prompt), ""), (8, "short", "x"), (9, None, None)], "item_id long, prompt string, answer string")
    assert set(rows(leakage.leaked_runs(d, q))) == set(want)


def test_two_edits_far_apart_and_a_nickname_among_many(spark):
    df = lambda *w: spark.createDataFrame([(x,) for x in w], "key string")
    assert rows(names.similar_tokens(df("pexersbuxghers"), df("petersburghers", "pettersbergher"))) == [("pexersbuxghers", "petersburghers")]
    e = [(f"s{i:03d}", f"Nam{i}el Smith", "person", None) for i in range(400)] + [("robert", "Robert Smith", "person", None), ("pb", "Petersburghers Union", "organization", None)]
    e += [(f"r{i}", f"Robert Quin{i}tor", "person", None) for i in range(3)]
    known = [(900 + i, f"r{i}", f"Bob Quin{i}tor") for i in range(3)]
    mentions = ["bob smith", "Pexersbuxghers Union", "Bobb Smith", "Smith, Bob", "BobSmith", "Robert S mith", "Jane Smith"]
    p = spark.createDataFrame([(i, None, m) for i, m in enumerate(mentions)] + known, P)
    got = dict(rows(names.link_mentions(p, spark.createDataFrame(e, E), spark.createDataFrame([], "entity_id string, alias string"))))
    assert got[0] == got[2] == got[3] == got[5] == "robert" and got[1] == "pb" and 6 not in got


def test_long_tokens_and_strange_names_do_no_harm(spark):
    e = [("1", "x" * 5000, "person", None), ("2", "Anna " * 30 + "Kolotir", "person", None), ("3", "", "person", None), ("4", "…", "organization", None)]
    m = ["x" * 4999, "x" * 4990, "Anna " * 29 + "Kolotir", "", " ", "…", "A.", "퟿"]
    p = spark.createDataFrame([(i, None, t) for i, t in enumerate(m)] + [(99, None, None)], P)
    got = dict(rows(names.link_mentions(p, spark.createDataFrame(e, E), spark.createDataFrame([("1", None), ("9", "Nobody")], "entity_id string, alias string"))))
    assert got.get(0) == "1" and 1 not in got and got.get(2) == "2"


def test_common_subsequences_against_the_table():
    g = np.random.default_rng(1)
    for a, b in ((1, 1), (7, 19), (24, 24), (63, 30)):
        x, y = g.integers(0, 6, (40, a)).astype(np.uint64), g.integers(0, 6, (40, b)).astype(np.uint64)
        for k, n in enumerate(leakage.lcs_lengths(x, y).tolist()):
            t = [[0] * (b + 1) for _ in range(a + 1)]
            for i in range(a):
                for j in range(b):
                    t[i + 1][j + 1] = t[i][j] + 1 if x[k, i] == y[k, j] else max(t[i][j + 1], t[i + 1][j])
            assert n == t[a][b]


def test_a_mention_does_not_carry_the_partners_of_its_tokens(spark, monkeypatch):
    sent, real = [], namejoin.candidates

    def candidates(asked, *rest):
        sent.append(asked.agg(F.sum(sum(F.length(c) for c in asked.columns if c != "bucket"))).first()[0])
        return real(asked, *rest)

    monkeypatch.setattr(namejoin, "candidates", candidates)
    for many in (5, 300):  # short forms of one word, each attested by two names
        e = [(f"{x}{i}", f"{w}{i} Incorporated", "organization", None) for i in range(300) for x, w in (("a", "Kolomir"), ("b", "Tavendor"))]
        aliases = [(f"{x}{i}", f"{w}{i} Qz{i}vek") for i in range(many) for x, w in (("a", "Kolomir"), ("b", "Tavendor"))]
        p = spark.createDataFrame([(0, None, "Incorporated Kolomir3"), (1, None, "Tavendor2 qz4vek"), (2, None, "Kolomir1 qz1vek")], P)
        got = dict(rows(names.link_mentions(p, spark.createDataFrame(e, E), spark.createDataFrame(aliases, "entity_id string, alias string"))))
        assert got == {0: "a3", 1: "b2", 2: "a1"}
    assert sent[1] < 1.2 * sent[0]
