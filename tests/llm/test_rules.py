"""Operators against brute force where SQL can't express them, and where corpora have odd rows or need the ways for large sizes."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from test_operators import ROWS, SCHEMA, _words

from leafgrid.llm import blocks, fingerprints, language_model, line_dedup, mixing, ngram_join, substrings
from leafgrid.llm.chat import escape, format_conversations
from leafgrid.llm.decontaminate import find_contamination
from leafgrid.llm.fingerprints import fingerprint_with_edits, idf_band, lexicon_rules
from leafgrid.llm.language_model import score_texts
from leafgrid.llm.line_dedup import drop_common_lines
from leafgrid.llm.mixing import mix_sources
from leafgrid.llm.ngram_join import link_near_copies
from leafgrid.llm.quality import fit_quality, score_quality
from leafgrid.llm.queries import ORACLE_SQL, QUERIES
from leafgrid.llm.substrings import drop_repeats, maximal_repeats
from leafgrid.llm.url_filter import FALLBACK_RULES, HOST_RULES, judge_urls

SF = "/root/testdata/sf0.001"
SCRIPTS = {"op1_quality", "op5_mixing", "op6_language_model", "op8_chat", "op9_fingerprints"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("run", [drop_repeats, score_texts, link_near_copies])
def test_offices_change_nothing(docs, monkeypatch, run):
    want = _rows(run(docs))
    monkeypatch.setattr(blocks, "MOST_RANGES", 3)
    assert _rows(run(docs)) == want


def test_hot_prefixes_change_nothing(docs, monkeypatch):
    want = _rows(drop_repeats(docs))
    monkeypatch.setattr(substrings, "GROUP_STRETCHES", 1)
    assert _rows(drop_repeats(docs)) == want


def test_rows_without_ids_are_dealt_by_text(spark, monkeypatch):
    r, vocabulary = random.Random(8), [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=40)
    texts = [" ".join([*r.choices(vocabulary, k=r.randint(0, 30)), *passage[r.randint(0, 9) :], *r.choices(vocabulary, k=30)]) for _ in range(300)]
    texts += texts[:20] + [" ".join(f"q{i}" for i in range(80)) + e for e in ("", " x", " y")]
    rows = [(None if i % 3 else i, t, "st"[i % 2]) for i, t in enumerate(texts)] + [(None, None, "s")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # One block, one chunk and one range don't get them all.
    none = docs.where("doc_id IS NULL")
    assert blocks.in_blocks(none, blocks.Plan(24, 24)).groupBy("block").count().toPandas()["count"].max() < 60
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 40)
    monkeypatch.setattr(mixing, "CHUNK_DOCS", 40)
    sizes, kind = [], type(docs)
    monkeypatch.setattr(kind, "groupBy", lambda self, *by, f=kind.groupBy: (by == ("source", "group") and sizes.append(f(self, *by).count().toPandas()["count"].max()), f(self, *by))[1])
    assert mix_sources(docs).count() == len(rows) and sizes[0] < 100
    following = fingerprints.with_next(docs, ["text"]).collect()
    assert Counter(x.text for x in following) == Counter(x.next_text for x in following) == Counter(t for _, t, _ in rows)
    # The order among them is that of a hash of their text.
    mark = lambda t: int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=4).digest(), "little") >> 1
    want, seen = Counter(), set()
    for i, t, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, mark(x[1]), x[1] or "")):
        w = (t or "").split()
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(k)
        want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    assert Counter((x.doc_id, x.n_words, x.n_removed, x.text) for x in drop_repeats(docs).collect()) == want


@pytest.mark.parametrize("grams", [6_000_000, 400])
def test_texts_without_ids_lose_no_link(spark, monkeypatch, grams):
    text = lambda name, n=60, edit="": " ".join(f"{name}{i}" for i in range(n)) + edit
    near = [(i if i % 2 else None, text("a", edit=f" e{i} f{i}")) for i in range(1, 30)] + [(i if i % 4 else None, text("b", edit=f" g{i}")) for i in range(31, 50)]
    apart = [(i, text("c", edit=f" h{i}")) for i in range(61, 70)] + [(i, text(f"d{i}x")) for i in range(80, 84)] + [(None, text(f"k{i}x")) for i in range(9)]
    monkeypatch.setattr(ngram_join, "GROUP_GRAMS", grams)
    got = Counter((x.doc_id, x.component_id) for x in link_near_copies(spark.createDataFrame(near + apart, "doc_id long, text string").repartition(4)).collect())
    # Rows without a doc_id are one document, the smallest, so all that they are linked with is one component.
    want = Counter((i, None) for i, _ in near) + Counter((i, None if i is None else 61 if i < 70 else i) for i, _ in apart)
    assert got == want


@pytest.mark.parametrize("window", [1, 3, 8, 9, 33])
def test_other_windows(docs, window):
    got, seen = {r["doc_id"]: r["n_removed"] for r in drop_repeats(docs, window).collect()}, set()
    for i, t, *_ in ROWS:
        w = _words(t)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if k in seen:
                gone[a : a + window] = [True] * window
            seen.add(k)
        assert got[i] == sum(gone)


def test_maximal_repeats():
    r = random.Random(1)
    for _ in range(150):
        texts, least = [[r.choice("abc") for _ in range(r.randint(0, 14))] for _ in range(r.randint(1, 4))], r.randint(1, 4)
        places = defaultdict(set)
        for i, q in enumerate(texts):
            for a in range(len(q)):
                for b in range(a + least, len(q) + 1):
                    places[tuple(q[a:b])].add((i, a))
        want = set()
        for w, p in places.items():
            before = {texts[i][a - 1] if a else ("start", i) for i, a in p}
            after = {texts[i][a + len(w)] if a + len(w) < len(texts[i]) else ("end", i) for i, a in p}
            if len(p) > 1 and len(before) > 1 and len(after) > 1:
                want.add((len(w), frozenset(p)))
        assert maximal_repeats(texts, least) == want


@pytest.mark.parametrize("sent", [200_000, 1])
def test_lines_are_counted_by_document(spark, monkeypatch, sent):
    monkeypatch.setattr(line_dedup, "MOST_SENT", sent)
    rows = [(7, f"x\nseven {i}") for i in range(12)] + [(8, "x\ny")] + [(None, "z")] * 12 + [(i, " Y \nown") for i in range(20, 29)] + [(40, "z\n\n")]
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = Counter((7, f"x\nseven {i}", 2, 0) for i in range(12)) + Counter({(8, "x", 2, 1): 1, (None, "z", 1, 0): 12, (40, "z\n\n", 3, 0): 1}) + Counter((i, "own", 2, 1) for i in range(20, 29))
    assert got == want


def test_carried_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, "a b", 5, "c")], "doc_id long, text string, lines int, items string")
    assert drop_common_lines(df, carry=("lines", "items")).select("lines", "items").first() == (5, "c")
    test = spark.createDataFrame([(1, "b")], "item_id long, text string")
    got = find_contamination(df.withColumnRenamed("items", "keys"), test, carry=("lines", "keys")).first()
    assert (got["lines"], got["keys"], got["items"]) == (5, "c", ["1"])


def test_language_model_score(docs):
    learn = {i for i, *_ in ROWS if zlib.crc32(str(i).encode()) % 5 != 1}
    one, two, three = Counter(), Counter(), Counter()
    said = {i: [*_words(t, True), None] for i, t, *_ in ROWS}
    steps = {i: list(zip(["<<", "<", *w], ["<", *w], w, strict=False)) for i, w in said.items()}
    for i in learn:
        one.update(said[i])
        two.update((v, w) for _, v, w in steps[i])
        three.update(steps[i])
    context = lambda v: one[None] if v == "<" else one[v]
    pairs = lambda u, v: two[u, v] if two[u, v] > 1 else 0
    mass = sum(one.values()) + 0.5 * (len(one) + 1)
    bucket = lambda n: n.bit_length()

    def learned(evidence):
        weight = {}
        for b, ratios in evidence.items():
            x, r = 0.5, np.array(ratios)
            for _ in range(language_model.ROUNDS):
                x = min(max((x * r / (x * r + 1 - x)).mean(), 1e-6), 1 - 1e-6)
            weight[b] = x
        return weight

    evidence = defaultdict(list)
    for i in learn:
        for _, v, w in steps[i]:
            if context(v) > 1:
                evidence[bucket(context(v) - 1)].append((two[v, w] - 1) / (context(v) - 1) / (one[w] - 0.5) * mass)
    second = learned(evidence)

    def bigram(v, w, less=0):
        n = context(v) - less
        x = second.get(bucket(n), 0.5) if n else 0.0
        return x * (two[v, w] - less) / max(n, 1) + (1 - x) * (one[w] - less + 0.5) / mass

    evidence = defaultdict(list)
    for i in learn:
        for u, v, w in steps[i]:
            if pairs(u, v):
                evidence[bucket(pairs(u, v) - 1)].append((three[u, v, w] - 1) / (pairs(u, v) - 1) / bigram(v, w, 1))
    third = learned(evidence)
    assert sum(map(len, evidence.values())) > 100
    got = {r.doc_id: r.score for r in score_texts(docs).collect()}
    for i in said:
        want = 0.0
        for u, v, w in steps[i]:
            x = third.get(bucket(pairs(u, v)), 0.5) if pairs(u, v) else 0.0
            want += math.log10(x * three[u, v, w] / max(pairs(u, v), 1) + (1 - x) * bigram(v, w))
        assert math.isclose(got[i], want, rel_tol=1e-4), i


@pytest.mark.parametrize("drop", [0, 14])
def test_keys_come_back(drop):
    keys = np.unique(np.random.default_rng(1).integers(1 << 40, 1 << 63, 3000, dtype=np.uint64))
    data = blocks.coded(keys[:0], 5) + blocks.coded(keys, 12345, drop)
    none, at = blocks.decoded(data)
    got, end = blocks.decoded(data, at)
    assert not len(none) and end == len(data)
    assert (got + np.uint64(12345 >> drop) == keys >> np.uint64(drop)).all()


def _term(word):
    return int(np.uint64(xxhash.xxh64(word, seed=42).intdigest()).astype(np.int64))


def _fold(terms):
    h = 42
    for t in terms:
        h = xxhash.xxh64(np.int64(t).tobytes(), seed=h).intdigest()
    return f"{h:016X}"[-8:]


def _fingerprint(text, band):
    terms = sorted({_term(w) for w in _words(text, True)})
    some = [t for t in terms if all(band[(p := (t & (1 << 64) - 1) >> probe & 64 * len(band) - 1) >> 6] >> (p & 63) & 1 for probe in fingerprints.PROBES)]
    keeps = lambda t, rule: t >> rule[0] & rule[1] == rule[2] if rule[1] else True
    return "".join(_fold([t for t in some or terms if keeps(t, every) and keeps(t, a) and keeps(t, b)]) for every, first, second in lexicon_rules() for a in first for b in second)


def _likeness(a, b):
    if a == b:
        return 1.0
    cut = lambda s: [s[i : i + 8] for i in range(0, len(s), 8)]
    pairs, best = list(zip(cut(a), cut(b), strict=True)), 0.0
    for k in range(3):
        part = [p for p in pairs[16 * k : 16 * k + 16] if p != (fingerprints.NONE,) * 2]
        best = max(best, sum(x == y and x != fingerprints.NONE for x, y in part) / max(len(part), fingerprints.ENOUGH))
    return best


@pytest.mark.parametrize("size", [3000, 20])
def test_fingerprints_by_hand(docs, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", size)
    counts, limits = Counter(t for _, text, *_ in ROWS for t in {_term(w) for w in _words(text, True)}), (0.03, 0.3)
    band = [b & (1 << 64) - 1 for b in idf_band(docs, *limits)]
    inside = [t for t, n in counts.items() if n > 1 and limits[0] * len(ROWS) <= n <= limits[1] * len(ROWS)]
    places = {(t & (1 << 64) - 1) >> p & 64 * len(band) - 1 for t in inside for p in fingerprints.PROBES}
    assert sum(bin(b).count("1") for b in band) == len(places) and all(band[p >> 6] >> (p & 63) & 1 for p in places) and inside
    got, order = {r.doc_id: r for r in fingerprint_with_edits(docs, *limits).collect()}, sorted(ROWS, key=lambda r: -r[0])
    for k, (i, t, *_) in enumerate(order):
        following, r = order[(k + 1) % len(order)][1] or "", got[i]
        edited = (t or "")[: len(t or "") - len(t or "") // 3] + following[: len(t or "") // 3]
        prints = [_fingerprint(x, band) for x in (t or "", edited, following)]
        assert (r.fingerprint, r.edited_fingerprint, r.edited_text) == (*prints[:2], edited), i
        assert math.isclose(r.near_edited, _likeness(*prints[:2])) and math.isclose(r.near_next, _likeness(prints[0], prints[2]))


def test_lexicons_overlap():
    for every, first, second in lexicon_rules():
        bits = [(s, m) for s, m, _ in [every, *first, *second] if m]
        used = [s + i for s, m in bits for i in range(m.bit_length())]
        assert len(used) == len(set(used)) and max(used) < 64  # rules of their own bits are independent, so subsets overlap


@pytest.mark.parametrize(("chunk", "sources"), [(1000, 100_000), (9, 100_000), (9, 1)])
def test_mixing_targets(docs, monkeypatch, chunk, sources):
    for name, value in (("CHUNK_DOCS", chunk), ("CHUNKS_AT_ONCE", 2 if chunk == 9 else 64), ("MOST_SOURCES", sources)):
        monkeypatch.setattr(mixing, name, value)
    rows, size, of = mix_sources(docs).collect(), Counter(), {i: s for i, _, s, *_ in ROWS}
    for i, t, s, *_ in ROWS:
        size[s] += len(_words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}, {}
    while True:  # what is above its cap stops there, and the others share what is left by weight
        free = [s for s in order if s not in target]
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * size[s] for s in free if share[s] > 3.0 * size[s]}
        if not over:
            target |= share
            break
        target |= over
    for r in rows:
        assert (r.size, r.source_size) == (len(_words(next(t for i, t, *_ in ROWS if i == r.doc_id))), size[of[r.doc_id]])
        assert math.isclose(r.target, target[of[r.doc_id]]) and r.taken <= 3 * r.size
    largest = {s: max(r.size for r in rows if of[r.doc_id] == s) for s in order}
    assert all(abs(sum(r.taken for r in rows if of[r.doc_id] == s) - target[s]) <= 0.05 * target[s] + 0.25 * largest[s] for s in order)


def test_urls_equal_sql(spark):
    r = random.Random(3)
    parts = ["ads", "adserver", "tracker", "banner", "login", "signup", "cart", "checkout", "loginx", "x", "EN", "en", "es", "fr", "www", "example", "com", "net", "org", "\n", ""]
    urls = [r.choice(["http://", "https://", "", "://"]) + ".".join(r.choices(parts, k=r.randint(1, 4))) + "/".join(["", *r.choices(parts, k=r.randint(0, 5))]) + r.choice(["", "?q=/login", "#/ads/"]) for _ in range(1500)]
    urls += [None, "", "http://x.org/a\n/login", "http://x.org/" + "a/" * 50_000 + "login", "http://x.org/login\n", urls[0], urls[0], "HTTP://ADS.x.org"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = judge_urls(pages, HOST_RULES, FALLBACK_RULES).toPandas()
    con = duckdb.connect()
    frame = pages.select("page_id", "url").toPandas()  # noqa: F841
    con.register("pages", frame)
    want = con.sql(ORACLE_SQL["op4_url_filter"]).df()
    rows = lambda df: sorted((int(a), b, c, d if isinstance(d, str) else None, e) for a, b, c, d, e in df[["page_id", "host", "path", "rule", "verdict"]].itertuples(index=False))
    assert rows(got) == rows(want) and all(rule.literals for rule in [*HOST_RULES, *FALLBACK_RULES])
    assert judge_urls(pages.where("false"), HOST_RULES, FALLBACK_RULES).count() == 0


def test_chat_query(spark):
    got = {r.conv_id: r for r in QUERIES["op8_chat"](spark, SF).collect()}
    said = "\\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert got.keys() == {r[0] for r in rows}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in got:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        written = sum(len(f"### {r}: {escape(t)} </turn>\n") for r, t in turns)
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[conv].loss_chars, got[conv].loss_sha256, got[conv].formatted_chars) == (len(loss), sha(loss), written)
    assert got[-7].loss_chars == len(said)


def test_chat_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, spans int"
    assert format_conversations(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, "user", "x" * 300_000, "clash", 1), (1, 0, "user", "x" * 300_000, "clash", 1), (None, None, None, None, None, None)]
    got = {r.conv_id: r.n_turns for r in format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: 2, None: 1}


def test_empty_tables_and_repeats(spark):
    schema, items = "doc_id long, text string, items string, score string", spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none, twice = spark.createDataFrame([], schema), spark.createDataFrame([(5, "a b", "x", "y")] * 2 + [(None, None, None, None)], schema)
    labels = spark.createDataFrame([(5, 1), (5, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    for run in (lambda d: find_contamination(d, items), lambda d: score_quality(d, fit_quality(d, labels))):
        assert run(none).count() == 0 and run(twice).count() == 3
    assert find_contamination(twice, items.where("false")).where("contaminated").count() == 0
    assert score_quality(twice, fit_quality(twice, labels.where("false"))).where("score > 0 AND score < 1").count() == 3


@pytest.mark.parametrize("name", sorted(SCRIPTS - {"op8_chat"}))
def test_registered_queries_without_sql(spark, name):
    got = QUERIES[name](spark, SF).collect()
    ids = Counter(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    # Whitening and SimHash are held against brute force in test_draws.
    assert Counter(r.doc_id for r in got) == ids and set(QUERIES) - set(ORACLE_SQL) == SCRIPTS | {"op11_whitening", "op12_simhash"}
