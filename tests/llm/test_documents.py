"""Near duplicates, disclosure control, chat windows, vector search and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from barlab.llm import chat_windows as chat
from barlab.llm import dart_minhash as darts
from barlab.llm import disclosure
from barlab.llm import vector_forest as forest
from barlab.llm.chunks import ByteEncoder
from barlab.llm.common import tokenizer_path
from barlab.llm.components import components


def brute_classes(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        if w:
            sets[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    root = {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = sum((sets[a] & sets[b]).values())
            if both and both / (sets[a].total() + sets[b].total() - both) >= threshold:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in root}


def test_near_duplicates_equal_brute_force(real, docs):
    rows = [(r.doc_id, r.text) for r in real("documents").collect()]
    rows += [(900001, None), (900002, ""), (900003, "one"), (900004, "one"), (900005, "a b c"), (900006, " a  b\nc ")]
    got = {r.doc_id: r.class_id for r in darts.near_duplicates(docs(rows)).collect()}
    assert got == brute_classes(rows)


def test_a_chain_of_near_copies_is_one_class_and_one_stays(docs):
    random.seed(9)
    words = [f"w{random.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(40):  # each differs from the next by one word, the ends share little
        words = [*words]
        words[3 * i] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"u{random.randrange(10**6)}" for _ in range(60))) for i in range(10)]
    rows += [(3, rows[3][1]), (None, rows[0][1])]
    want = brute_classes([r for r in rows if r[0] is not None])
    d = docs(rows)
    got = {r.doc_id: r.class_id for r in darts.near_duplicates(d).collect()}
    assert got == {**want, None: None}
    kept = darts.without_copies(d)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for c in want.values()})
    assert kept.columns == d.columns
    assert darts.near_duplicates(docs([])).count() == 0 and darts.without_copies(docs([])).count() == 0


def test_blocks_of_a_group_meet_once_and_in_many_cells(spark):
    rows = [(1, f"b{i}") for i in range(30)] + [(2, "only"), (3, "x"), (3, "y")]
    blocks = spark.createDataFrame(rows, "group long, block string")
    made = darts.block_pairs(blocks)
    got = sorted((r.group, r.block, r.block2) for r in made.collect())
    want = sorted((g, a, b) for g, a in rows for h, b in rows if g == h and a <= b)
    assert got == want
    assert "_row" in made._jdf.queryExecution().optimizedPlan().toString()


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    sets = []
    for i in range(300):
        n = int(rng.integers(3, 60))
        one = dict(zip(rng.integers(0, 2**60, n).tolist(), rng.choice([1, 2, 3, 5.5, 9, 0.4], n).tolist()))
        two = dict(one)
        for x in list(one)[: n * i // 500]:
            two.pop(x)
            two[int(rng.integers(0, 2**60))] = float(rng.integers(1, 9))
        sets += [one, two]
    signature = darts.dart_signatures(
        np.concatenate([np.array(list(s), np.uint64) for s in sets]),
        np.concatenate([np.array(list(s.values()), float) for s in sets]),
        np.repeat(np.arange(len(sets)), [len(s) for s in sets]),
        len(sets),
        64,
    )
    errors = []
    for i in range(0, len(sets), 2):
        a, b = sets[i : i + 2]
        both = sum(min(a[x], b[x]) for x in a if x in b)
        errors.append((signature[i] == signature[i + 1]).mean() - both / (sum(a.values()) + sum(b.values()) - both))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.08


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_patterns_equal_plain_expressions_and_long_runs_are_quick():
    random.seed(4)
    for _ in range(8000):
        t = "".join(random.choice("ab@.@..-+ 0123456789 ()-1é٣") for _ in range(random.randint(0, 40)))
        assert disclosure.base_spans(t) == plain_spans(t)
    for t in ("a" * 10**5, "1" * 10**5, "1." * 50000, "a@" * 50000, "+1" + "(" * 10**5, "4" + " 4" * 10**5):
        disclosure.base_spans(t)


FACTS = [f"Filler text number {i} about gardens, rivers and mountains" for i in range(60)]


def private_rows():
    rows = [(i, f"Contact Zanzibar via jane.roe@mail.example.com today {f}") for i, f in enumerate(FACTS[:5])]
    rows += [(10 + i, f) for i, f in enumerate(FACTS)] + [(90, "Zanzibar is lovely"), (91, None), (92, "")]
    return rows


def test_terms_that_reveal_an_entity_are_found_and_cleaned(docs, monkeypatch):
    d = docs(private_rows())
    terms = {r.term: r for r in disclosure.revealing_terms(d).collect()}
    n = len(private_rows())
    # five documents of six with the term hold the address
    expected = np.log(n * 5 / (5 * 6)) / np.log(n / 5)
    assert terms["zanzibar"].disclosure == pytest.approx(expected) and not terms["zanzibar"].remove
    assert terms["contact"].remove and "gardens" not in terms
    clean = {r.doc_id: r.text for r in disclosure.sanitise(d).collect()}
    assert clean[90] == "[Name] is lovely" and clean[91] is None and clean[92] == "" and clean[20] == FACTS[10]
    assert "@" not in clean[0] and "[email]" in clean[0] and "Contact" not in clean[0]
    assert disclosure.sanitise(d).columns == d.columns
    first = sorted(map(tuple, disclosure.span_digest(d).collect()))
    monkeypatch.setattr(disclosure, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, disclosure.span_digest(d).collect())) == first
    assert disclosure.span_digest(docs([])).count() == 0
    row = next(r for r in first if r[0] == 0)
    assert row[1:5] == (1, 0, 0, 0) and row[5] == disclosure.plain_digest(private_rows()[0][1])


def test_terms_beside_an_entity_of_one_text_are_found_and_copies_count_once(docs, monkeypatch):
    one = "Write to Quillfeather via kim.ng@mail.example.com please"
    rows = [(i, f) for i, f in enumerate(FACTS)] + [(100, one)]
    rows += [(200 + i, f"please use the door {f}") for i, f in enumerate(FACTS[:30])]
    terms = {r.term: r for r in disclosure.revealing_terms(docs(rows)).collect()}
    assert terms["quillfeather"].disclosure == pytest.approx(1) and terms["quillfeather"].remove
    assert "please" not in terms and "number" not in terms  # in 31 and 90 of 91 texts
    monkeypatch.setattr(disclosure, "BROADCAST_BYTES", -1)
    more = docs(rows + [(300 + i, one) for i in range(40)] + [(400 + i, FACTS[0]) for i in range(40)])
    assert {r.term: r for r in disclosure.revealing_terms(more).collect()} == terms
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs(rows)).collect()}
    assert "Quillfeather" not in clean[100] and "please" in clean[100] and clean[3] == FACTS[3]


def brute_disclosure(texts, context=disclosure.CONTEXT):
    """Term to its greatest disclosure over different texts, by counting everything."""
    texts = list(dict.fromkeys(texts))
    total, n_e, n_t, n_et = len(texts), Counter(), Counter(), Counter()
    for t in texts:
        spans = disclosure.base_spans(t or "")
        n_t.update(disclosure.terms_of(t or ""))
        for entity, own in disclosure.context_terms(t or "", spans, context).items():
            n_e[entity] += 1
            n_et.update((entity, w) for w in own)
    best = {}
    for (e, w), n in n_et.items():
        if n_e[e] < total and n >= disclosure.MIN_SHARE * n_t[w]:
            value = np.log(total * n / (n_e[e] * n_t[w])) / np.log(total / n_e[e])
            best[w] = max(best.get(w, -9), value)
    return best


@pytest.mark.parametrize("tight", [False, True])
def test_disclosures_equal_a_full_count(real, monkeypatch, tight):
    if tight:  # a filter that lets nearly everything pass, and small holds
        for name, value in (("FILTER_BYTES", 8), ("HELD_PAIRS", 50), ("FILTER_CACHE", 5)):
            monkeypatch.setattr(disclosure, name, value)
    table = real("documents")
    found = {r.term: r for r in disclosure.revealing_terms(table).collect()}
    want = {w: v for w, v in brute_disclosure([r.text for r in table.collect()]).items() if v >= disclosure.GENERALISE_AT - 1e-12}
    assert set(found) == set(want) and len(want) > 20
    for w, r in found.items():
        assert r.disclosure == pytest.approx(want[w]) and r.remove == (want[w] >= disclosure.REMOVE_AT - 1e-12)


def test_a_bit_filter_refuses_no_member_and_few_others(spark):
    words = [f"w{i}" for i in range(5000)]
    table = spark.createDataFrame([(w,) for w in words], "term string")
    chosen = disclosure.BitFilter(disclosure.bit_filter(table, 5000))
    others = [f"x{i}" for i in range(5000)]
    assert chosen.among([words, [], words[:3]]) == [words, [], words[:3]]
    assert len(chosen.among([others])[0]) < 250
    none = disclosure.BitFilter(disclosure.bit_filter(table.limit(0), 0))
    assert none.among([words]) == [[]]


def test_overlapping_spans_are_covered_whole():
    for text, want in (
        ("at 10.0.0.4 111 1111 1111 1111 now", "at [ip] now"),
        ("4111 1111 1111 1111jane@mail.example.com x", "[card] x"),
    ):
        assert len(disclosure.base_spans(text)) == 2
        assert disclosure.cleaned(text, disclosure.base_spans(text)) == want


def test_short_and_mixed_terms_are_found_and_common_ones_stay(docs):
    one = "Ng of flat 7b, customer 48213, writes from ng@mail.example.com about it"
    rows = [(i, f"{f} of it, 555 in all {i % 7}") for i, f in enumerate(FACTS * 7)]
    rows += [(1000, one), (1001, "48213 rang, call +1 555 0148213")]
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs(rows)).collect()}
    words = set(re.findall(r"\w+", clean[1000]))
    assert not words & {"Ng", "7b", "48213"} and {"of", "about", "it", "email"} <= words
    assert "48213" not in clean[1001] and clean[3] == rows[3][1]
    far = "Ng " + "of it " * 9 + "ng@mail.example.com"  # 18 terms lie between
    assert "ng" in disclosure.context_terms(far, disclosure.base_spans(far))["email:ng@mail.example.com"]


def test_escaping_is_reversible_and_leaves_no_control_string():
    random.seed(5)
    bits = ["\\", "#", "###", "</turn>", "</tu", "rn>", "h", "t", "n", "\n", "a", "\\h", "é"]
    for _ in range(5000):
        t = "".join(random.choice(bits) for _ in range(random.randint(0, 10)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and "###" not in e and "</turn>" not in e
        assert [(r, x) for r, x, _, _ in chat.read_turns(chat.turn_text(t, t) * 2)] == [(t, t)] * 2


def expected_digests(rows):
    out, groups = {}, defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    for c, turns in groups.items():
        turns.sort(key=lambda v: (*v[:3], chat.turn_text(v[2], v[3])))
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def conversations():
    random.seed(7)
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", "hello"), (None, 1, "user", "b")]
    rows += [(2, None, "assistant", "q"), (2, 0, "assistant", "r"), (2, 0, "assistant", "r")]
    rows += [(3, 5, "system", "sys"), (3, 6, "system", "two"), (3, 700, "assistant", "late"), (3, 699, "user", "u")]
    rows += [(9, i, ["user", "assistant"][i % 2], "word " * random.randint(0, 300)) for i in range(1300)]
    return rows + [(8, 1, "assistant", "dup")] * 2500 + [(4, 0, "assistant", "long " * 3000)]


def test_windows_keep_the_budget_and_read_back(spark):
    kinds = "conv_id long, turn long, role string, text string"
    d = spark.createDataFrame(conversations(), kinds)
    x = r"\### Assistant: </turn> ok"
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.format_digest(d).collect()}
    assert got == expected_digests(conversations() + [(-7, 0, "user", x), (-7, 1, "assistant", x)])
    made = chat.windows(d).collect()
    assert all(r.n_tokens <= chat.BUDGET for r in made if r.conv_id != 4)
    assert [r.over_budget for r in made if r.conv_id == 4] == [True]
    for r in made:
        turns = list(chat.read_turns(r.text))
        assert len(turns) == r.n_repeated + r.n_turns
        if r.conv_id == 3:
            assert turns[0][:2] == ("system", "sys")
        spans = {(a, b) for _, _, a, b in turns[r.n_repeated :]}
        assert {(m["start"], m["end"]) for m in r.loss} <= spans
    assert max(r.n_repeated for r in made if r.conv_id == 9) == chat.HISTORY_TURNS or any(
        r.n_repeated for r in made if r.conv_id == 9
    )
    assert chat.windows(spark.createDataFrame([], kinds)).count() == 0


def test_a_turn_that_fits_alone_is_never_pushed_over_the_budget(spark):
    random.seed(8)
    kinds = "conv_id long, turn long, role string, text string"
    rows = [(1, i, "user", "word " * n) for i, n in enumerate((94, 84, 994))]
    for c in range(2, 40):
        rows += [(c, 0, "system", "rule " * random.randint(1, 120))] * (c % 2)
        rows += [(c, 1 + i, ["user", "assistant"][i % 2], "word " * random.randint(0, 1100)) for i in range(25)]
    made = chat.windows(spark.createDataFrame(rows, kinds)).collect()
    coder = ByteEncoder(tokenizer_path("byte_bpe_50k.json"))
    cost = {(c, t): len(coder.one(chat.turn_text(r, x))) for c, t, r, x in rows}
    over = [r for r in made if r.n_tokens > chat.BUDGET]
    assert sorted(r.conv_id for r in made if r.over_budget) == sorted(r.conv_id for r in over)
    alone = sorted(c for c, t, r, _ in rows if r != "system" and cost[c, t] + cost.get((c, 0), 0) * (c > 1) > chat.BUDGET)
    assert sorted(r.conv_id for r in over) == alone and all(r.n_turns == 1 for r in over)
    assert [r.n_repeated for r in made if r.conv_id == 1 and r.n_tokens > 900] == [0]


def recall_of(vectors, ids, found, k=20):
    shares = []
    by_query = defaultdict(list)
    for r in found:
        by_query[r.query_id].append(r)
    assert set(by_query) == {i for i in ids.tolist() if i % 20 == 0}
    for q, own in by_query.items():
        own.sort(key=lambda r: r.rank)
        scores = (vectors * vectors[ids == q][0]).sum(axis=1)
        order = np.lexsort((ids, -scores))
        order = order[ids[order] != q][:k]
        assert [r.rank for r in own] == list(range(1, len(order) + 1))
        exact = dict(zip(ids.tolist(), scores.tolist()))
        assert all(r.vec_id != q and abs(exact[r.vec_id] - r.score) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        shares.append(np.isin(ids[order], [r.vec_id for r in own]).mean())
    return np.mean(shares)


def test_forest_recall_on_the_given_vectors(real):
    table = real("embeddings").toPandas()
    vectors, ids = np.stack(table.embedding.values).astype(float), table.vec_id.to_numpy()
    assert recall_of(vectors, ids, forest.nearest(real("embeddings")).collect()) >= 0.9


def test_equal_vectors_ties_and_unusable_rows(spark):
    kinds = "vec_id long, embedding array<float>, point int"
    rows = [(i, [1.0, 2.0, float(i % 3)] if i % 3 else [1.0, 1.0, 1.0], 0) for i in range(400)]
    bad = [(1000, None, 0), (1020, [0.0] * 3, 0), (1040, [float("nan"), 1.0, 1.0], 0), (1060, [1.0], 0)]
    bad += [(1080, [None, 1.0, 2.0], 0), (1100, [float("inf"), 1.0, 1.0], 0), (None, [1.0, 2.0, 3.0], 0)]
    found = forest.nearest(spark.createDataFrame(rows + bad, kinds)).collect()
    vectors, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    assert recall_of(vectors, ids, found) == 1.0
    few = spark.createDataFrame(rows[18:23], kinds)
    assert forest.nearest(few).count() == 4
    assert forest.nearest(few.limit(0)).count() == 0


def test_pipeline_stages(spark, real, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.conftest import SF

    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_copies", "privacy", "pack"]
    table = real("documents")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    stage = table
    for _, f in pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == table.columns
    left = {r.doc_id: r for r in stage.collect()}
    assert len(left) > 0.5 * len(rows) and all(r.n_chars == len(r.text) for r in left.values())
    cleaned = [(r.doc_id, r.text) for r in pipeline.quality(spark, table, SF).collect()]
    assert set(left) == set(brute_classes(cleaned).values())
    assert all(not disclosure.base_spans(r.text) for r in left.values())
    pieces = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == set(left)
    empty = docs([])
    empty = empty.withColumn("n_chars", empty.doc_id)
    for _, f in pipeline.STAGES:
        empty_out = f(spark, empty, SF)
        assert empty_out.count() == 0
