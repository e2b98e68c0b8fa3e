"""Text operators against brute force on a small corpus with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.llm import blocks, decontaminate, ngram_join
from leafgrid.llm.chat import GrowingTemplate, format_conversations, locate, plain_template, plain_turn, read_back, unescape
from leafgrid.llm.decontaminate import find_contamination, find_contamination_in_parts
from leafgrid.llm.fingerprints import fingerprint_with_edits
from leafgrid.llm.language_model import score_texts
from leafgrid.llm.line_dedup import drop_common_lines
from leafgrid.llm.mixing import mix_sources
from leafgrid.llm.ngram_join import link_near_copies
from leafgrid.llm.quality import AdditiveModel, fit_quality, score_quality
from leafgrid.llm.substrings import drop_repeats
from leafgrid.llm.url_filter import FALLBACK_RULES, HOST_RULES, judge_urls

SCHEMA = "doc_id long, text string, source string, block string, size double, n long"


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abéÉCd") for _ in range(r.randint(1, 5)))
    vocabulary = [word() for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, line = text(60), "  A Common LINE\t"
    texts = [None, "", " \n\t ", "one", "One two\nthree", passage, "x" * 2000, "ab " * 90]
    base = text(120).split()
    for _ in range(12):
        words = base[:]
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [f"{text(30)}\n{line}\n{passage} {text(25)}" for _ in range(14)] + [text(r.randint(1, 80)) for _ in range(30)] + [texts[9]] * 3 + [text(4000)]
    return [(i * 3, t, r.choice(["a", "b", None, "é"]), "clash", 1.5, 7) for i, t in enumerate(texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def _words(text, fold=False):
    raw = (text or "").encode()
    return (raw.lower() if fold else raw).split()


def test_substrings(docs):
    got, seen = {r["doc_id"]: r for r in drop_repeats(docs, 20).collect()}, set()
    for i, t, *_ in ROWS:
        w = _words(t)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(k)
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), sum(gone)), i
        assert got[i]["text"].encode() == b" ".join(x for x, g in zip(w, gone, strict=True) if not g)


def _components(k=5, percent=75):
    sets = []
    for _, t, *_ in ROWS:
        w = _words(t, True)
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {ROWS[i][0]: (len(sets[i]), ROWS[find(i)][0]) for i in range(len(sets))}


@pytest.mark.parametrize("grams", [6_000_000, 400])
def test_near_copies(docs, monkeypatch, grams):
    monkeypatch.setattr(ngram_join, "GROUP_GRAMS", grams)  # the second splits groups into chunks
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in link_near_copies(docs).collect()}
    assert got == _components()


def test_no_task_holds_a_large_group(spark, monkeypatch):
    import numpy as np

    # The smallest document is an outlier of a family in several chunks; a second family is linked with neither.
    sets = {1: range(10**6, 10**6 + 100)} | {i: [*range(k, k + 90), *range(i * 1000, i * 1000 + 10)] for i in range(2, 162) for k in [500 * (i > 140)]}
    reps = spark.createDataFrame([(0, i, len(g), np.sort(np.array(g, np.uint64)).tobytes()) for i, g in sets.items()], "block int, rep long, n long, grams binary").cache()
    candidates = spark.createDataFrame([(i, 1) for i in sets], "node long, component long")
    monkeypatch.setattr(ngram_join, "GROUP_GRAMS", 2000)
    dealt, kind = [], type(reps)
    monkeypatch.setattr(kind, "groupBy", lambda self, *by, f=kind.groupBy: ("chunk" in [x for x in by if isinstance(x, str)] and dealt.append((self, by)), f(self, *by))[1])
    links = ngram_join._verified(reps, candidates, 75)
    found = {r.node: r.component for r in ngram_join.connected_components(links, "a", "b").collect()}
    monkeypatch.undo()
    assert found == {i: 2 if i <= 140 else 141 for i in sets if i > 1}
    held = [d.groupBy(*by).agg(F.sum(F.octet_length("grams") / 8).alias("n")).agg(F.max("n")).first()[0] for d, by in dealt]
    assert len(held) >= 2 and max(held) < 8000  # all of the group would be 16000


def test_language_model(docs):
    rows = score_texts(docs).collect()
    learn = [i for i, *_ in ROWS if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(x for i, t, *_ in ROWS if i in learn for x in [*_words(t, True), None])
    n, v = sum(counts.values()), len(counts)
    for r, (_, t, *_) in zip(sorted(rows, key=lambda r: r["doc_id"]), ROWS, strict=True):
        w = [*_words(t, True), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_line_dedup(docs):
    got = {r["doc_id"]: r for r in drop_common_lines(docs).collect()}
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    counts = Counter(k for _, t, *_ in ROWS for k in {key(x) for x in (t or "").split("\n")} if k)
    for i, t, *_ in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if counts[key(x)] < 10]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept)), i


def test_decontamination(spark, docs):
    items = [(1, ROWS[5][1]), (2, "One, TWO three"), (3, None), (4, "..."), (10, ROWS[5][1].upper())]
    got = {r["doc_id"]: r for r in find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), clean=True).collect()}
    table = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
    cut = lambda t: (t or "").encode().translate(table).split()
    windows = {}
    for i, t in items:
        w = cut(t)
        for a in range(max(1, len(w) - 9)):
            if w:
                windows.setdefault(tuple(w[a : a + 10]), set()).add(str(i))
    for i, t, *_ in ROWS:
        w = cut(t)
        hit, found = [0] * len(w), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    found |= windows[tuple(w[a : a + k])]
                    hit[a : a + k] = [1] * k
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), sum(hit), sorted(found)), i
        assert cut(got[i]["clean_text"]) == [x for x, h in zip(w, hit, strict=True) if not h]


def test_parts_of_a_benchmark_give_what_the_whole_does(spark, docs, monkeypatch):
    long = ROWS[-1][1]
    items = [(1, ROWS[5][1]), (2, "One, TWO three"), (3, None), (4, "..."), (10, ROWS[5][1].upper()), (10, ROWS[5][1]), (None, ROWS[8][1]), (5, long), (6, " ".join(long.split()[100:109]))]
    test = spark.createDataFrame(items, "item_id long, text string")
    twice = docs.union(docs.limit(9)).union(docs.limit(9).withColumn("doc_id", F.lit(None).cast("long")))
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(find_contamination(twice, test, clean=True, carry=("source",)))
    assert rows(find_contamination_in_parts(twice, test, clean=True, carry=("source",), part_words=1500)) == want
    seen = []
    monkeypatch.setattr(decontaminate, "_scanner", lambda part, f=decontaminate._scanner: (seen.append(sum(len(t.split()) for _, _, t in part.value[1])), f(part))[1])
    find_contamination_in_parts(docs, test, part_words=1500)
    assert len(seen) > 2 and max(seen) <= 1500


def test_mixing(docs):
    rows, again = mix_sources(docs).collect(), mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = (r["target"], r["source_size"])
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    size = sum(s for _, s in target.values())
    assert math.isclose(sum(t for t, _ in target.values()), size)
    for s, (t, have) in target.items():
        assert t <= 3 * have + 1e-6 and abs(taken[s] - t) <= max(0.02 * t, 0.25 * largest[s])  # documents are whole: one here has most of its source


def test_fingerprints(docs):
    got = {r["doc_id"]: r for r in fingerprint_with_edits(docs).collect()}
    order = sorted(ROWS, key=lambda r: -r[0])
    for k, (i, t, *_) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        assert got[i]["edited_text"] == t[: len(t) - cut] + following[:cut]
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) or got[i]["edited_text"] != t
    assert got[27]["fingerprint"] == got[ROWS[-2][0]]["fingerprint"]


def test_urls(spark):
    urls = ["http://a.com/x", "https://WWW.example.com/en/1", "http://m.example.com/en/", "http://example.com/en", "http://a.net/es/?q", "http://net/fr/#x", "http://ads.x.org/", "http://notexample.com/en/", "x", None, "://", "http://a.com", "http://b.net/ES/"]
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), HOST_RULES, FALLBACK_RULES).orderBy("page_id").collect()]
    assert [g[2] for g in got] == ["com/", "www.example.com/en/", "example.com/en/", "com/", "net/es/", "net/fr/", None, "com/", None, None, None, None, None]
    assert [g[3] for g in got] == ["allow", "allow", "block", "allow", "block", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow"]
    assert got[1][:2] == ("www.example.com", "/en/1") and got[8][:2] == ("", "")


def test_chat(spark):
    said = ["\\### Assistant: </turn> ok", "", None, "a\n### b </turn>\n", "####\\\\###", " </turn>", "<", "0", "1"]
    rows = [(1, i, "assistant" if i % 2 else "user: \n", t) for i, t in enumerate(said)] + [(None, 0, None, "x"), (1, 3, "assistant", "tie")]
    for r in format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        own = sorted([x for x in rows if x[0] == r["conv_id"]], key=lambda x: (x[1], x[2] or "", x[3] or ""))
        assert read_back(r["formatted"]) == [(x[2] or "", x[3] or "") for x in own] and not r["rewrites"]
        for x, s in zip(own, r["spans"], strict=True):
            assert unescape(r["formatted"][s["text_begin"] : s["text_end"]]) == (x[3] or "")


def test_templates_that_rewrite_history():
    last_only = lambda turns: "".join(f"[{r}:{t if k == len(turns) - 1 else '...'}]" for k, (r, t) in enumerate(turns))
    assert locate(last_only, [("a", "long"), ("b", "x"), ("a", "y")])[2] == [1, 2]
    assert locate(plain_template, [("a", "long"), ("b", "x")])[2] == []


def test_growing_template_is_the_plain_one():
    r, grown = random.Random(4), GrowingTemplate(plain_turn)
    said = [(r.choice("ab"), r.choice(["", "x", "</turn>", "0", "1", "long " * 50])) for _ in range(40)]
    for _ in range(300):  # longer and shorter ones, other ends and other beginnings
        k = r.randint(0, 40)
        turns = r.choice([said[:k], [*said[:k], ("a", r.choice("01"))], said[k:], [*said[: k // 2], ("b", "other"), *said[k:]]])
        assert grown(turns) == plain_template(turns)
    assert locate(GrowingTemplate(plain_turn), said) == locate(plain_template, said)


def test_long_conversations_keep_what_was_rendered():
    calls = []

    def turn(role, text):
        calls.append(role)
        return plain_turn(role, text)

    said = [("user" if i % 2 else "assistant", f"{i} " * 100) for i in range(1000)]
    out, spans, rewrites = locate(GrowingTemplate(turn), said)
    assert len(calls) <= 3 * len(said) and read_back(out) == said and not rewrites  # each turn with its two probes, once
    assert all(out[c:d] == t for (_, _, c, d), (_, t) in zip(spans, said, strict=True))


def test_rows_without_conversation_stand_alone(spark):
    rows = [(None, i, "user", "same") for i in range(50)] + [(None, 0, "user", "same"), (3, 1, "user", "b"), (3, 0, "user", "a")]
    got = [(r.conv_id, r.n_turns, r.formatted) for r in format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, "### user: same </turn>\n")] * 51 + [(3, 2, "### user: a </turn>\n### user: b </turn>\n")], key=str)


def test_quality_learns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs, fit_quality(docs, labels)).join(labels, "doc_id").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).toPandas()
    assert ((scored["score"] >= 0.3) == (scored["quality"] == 1)).mean() > 0.9


def _grown_by_loops(x, y, model):
    """The additive model by plain loops over rows, bins and cuts: the scores on the rows that it was fitted on."""
    n, wide = len(y), len(x[0])
    z = [math.log((sum(y) + 1) / (n + 2) / (1 - (sum(y) + 1) / (n + 2)))] * n

    def cuts(f, bins):
        return sorted(set(np.quantile([r[f] for r in x], np.linspace(0, 1, bins + 1)[1:-1]).tolist()))

    def slopes():
        p = [1 / (1 + math.exp(-v)) for v in z]
        return [b - a for a, b in zip(p, y)], [a * (1 - a) for a in p]

    def over(rows, g, h):
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1)

    fine, coarse = ([[sum(c <= r[f] for c in cuts(f, bins)) for r in x] for f in range(wide)] for bins in (model.bins, model.pair_bins))
    for _ in range(model.rounds):
        for f in range(wide):
            g, h = slopes()
            bins = len(cuts(f, model.bins)) + 1
            leaves = [(0, bins)]
            while len(leaves) < model.leaves:
                found = []
                for k, (a, b) in enumerate(leaves):
                    inside = lambda low, high: [i for i in range(n) if low <= fine[f][i] < high]
                    gains = [(over(inside(a, c), g, h) + over(inside(c, b), g, h) - over(inside(a, b), g, h) if min(len(inside(a, c)), len(inside(c, b))) >= model.least else 0.0, -c, k) for c in range(a + 1, b)]
                    found += [max(gains)] if gains else []
                if not found or max(found)[0] <= 1e-9:
                    break
                _, c, k = max(found, key=lambda t: (t[0], -t[1], t[2]))
                a, b = leaves[k]
                leaves[k : k + 1] = [(a, -c), (-c, b)]
            for a, b in leaves:
                rows = [i for i in range(n) if a <= fine[f][i] < b]
                step = model.rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)
                for i in rows:
                    z[i] += step

    def quarters(a, b, g, h):
        best = (0.0, 0, 0)
        for c in range(1, len(cuts(a, model.pair_bins)) + 1):
            for d in range(1, len(cuts(b, model.pair_bins)) + 1):
                parts = [[i for i in range(n) if (coarse[a][i] < c) == u and (coarse[b][i] < d) == v] for u in (True, False) for v in (True, False)]
                gain = sum(over(p, g, h) for p in parts) - over(range(n), g, h)
                if gain > best[0] + 1e-12:
                    best = (gain, c, d)
        return best

    g, h = slopes()
    ranked = sorted(((-quarters(a, b, g, h)[0], a, b) for a in range(wide) for b in range(a + 1, wide)))[: model.pairs_kept]
    for _ in range(model.pair_rounds):
        for _, a, b in ranked:
            g, h = slopes()
            gain, c, d = quarters(a, b, g, h)
            if gain > 1e-9:
                for u in (True, False):
                    for v in (True, False):
                        rows = [i for i in range(n) if (coarse[a][i] < c) == u and (coarse[b][i] < d) == v]
                        step = model.rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 5)
                        for i in rows:
                            z[i] += step
    return [1 / (1 + math.exp(-v)) for v in z], [(a, b) for _, a, b in ranked]


def test_additive_model_by_loops():
    r = np.random.default_rng(3)
    x = r.random((70, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4) | (r.random(70) < 0.1)).astype(float)
    model = AdditiveModel(bins=7, pair_bins=4, rounds=4, pair_rounds=5, pairs_kept=2, least=5.0).fit(x, y)
    want, pairs = _grown_by_loops(x.tolist(), y.tolist(), model)
    assert np.allclose(model.score(x), want, atol=1e-9) and model.pairs == pairs and pairs[0] == (0, 1)
    for row, got in zip(x, model.score(x), strict=True):  # a score is a sum of table entries
        at = lambda edges, v: sum(e <= v for e in edges)
        z = model.intercept + sum(t[at(e, v)] for e, t, v in zip(model.edges, model.tables, row, strict=True))
        z += sum(t[at(model.pair_edges[a], row[a]), at(model.pair_edges[b], row[b])] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        assert math.isclose(got, 1 / (1 + math.exp(-z)), rel_tol=1e-12)


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(0, 1), (3, None), (None, 0)], "doc_id long, quality int")
    rows = score_quality(docs, fit_quality(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("run", [drop_repeats, link_near_copies, score_texts, drop_common_lines, mix_sources, fingerprint_with_edits])
def test_empty_and_repeated(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(5, "a b c", None, "", 0.0, 0), (5, "a b c", None, "", 0.0, 0), (None, "a b c", None, "", 0.0, 0), (None, None, None, "", 0.0, 0)], SCHEMA)
    assert run(odd).count() == 4


def test_blocks_keep_counts():
    import numpy as np

    counts, flags = np.array([0, 1, 126, 127, 300, 1 << 40]), np.array([True, False, True, False, True, True])
    c, f = blocks.unpacked(blocks.packed(counts, flags), 6)
    assert c.tolist() == counts.tolist() and f.tolist() == flags.tolist()
    assert hashlib.sha256(b"").hexdigest()[:8] == "e3b0c442"


def test_features_do_not_depend_on_pieces():
    import numpy as np
    import pyarrow as pa

    from leafgrid.llm import quality as q

    texts = pa.array(["Some words, twice. Some words\n", None, "", "|x| " * 400, "é" * 90, "last"])
    whole = q.text_features(texts)
    assert whole.shape == (6, len(q.FEATURES)) and not whole[1:3].any()
    assert all(np.array_equal(whole, q.text_features(texts, n)) for n in (1, 7, 100))
    assert q.text_features(texts.slice(0, 0)).shape == (0, len(q.FEATURES))
