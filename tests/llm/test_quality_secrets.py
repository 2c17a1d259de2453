"""Native operators: quality rules and secrets, against plain Python."""

import hashlib
import random
import re
from collections import Counter

from barlab.llm import quality_rules as quality
from barlab.llm import secrets

PROSE = "The quick brown fox jumps over the lazy dog near the old river bank."
CLEAN = "\n".join(" ".join(f"{w}{i}" for w in PROSE[:-1].split()) + "." for i in range(8))


def figures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen = Counter(zip(words, words[1:], words[2:]))
    again = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(again),
        len(words) < 50 or 100 * len(again) > 50 * len(words),
    )


def test_figures_equal_a_plain_count(docs):
    random.seed(3)
    bits = ["a", "b", "é", "\U0001f600", " ", "\t", "\n", "\x0b", "\r", "#", "|", "a b c ", "\x1c", "!!"]
    texts = [None, "", " \n\t", CLEAN, "a b c " * 3000]
    texts += ["".join(random.choice(bits) for _ in range(random.randint(0, 60))) for _ in range(200)]
    got = {r.doc_id: r for r in quality.quality_report(docs(texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert figures(t) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed), t
        assert not (r.base_failed and r.kept)


def test_lines_fail_by_rule_and_documents_by_loss(docs):
    bad = ["Home | News | Sport | Weather | Login", "BUY!! NOW!! CHEAP!! GOODS!!", "a$$$ b### c*** d%%%", "© 2024 Acme", "Menu"]
    texts = [CLEAN + "\n" + "\n".join(bad), "\n".join(bad * 20) + "\n" + PROSE, CLEAN, None]
    d = docs(texts)
    kept = {r.doc_id: r for r in quality.clean_documents(d).collect()}
    assert set(kept) == {0, 2}
    assert kept[0].text == CLEAN and kept[2].text == CLEAN and kept[0]._quality == "x"
    assert quality.clean_documents(d).columns == d.columns
    assert quality.clean_documents(docs([])).count() == 0


def test_quality_and_secrets_stay_native(real):
    for df in (quality.quality_report(real("documents")), secrets.secret_digest(real("documents"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A
)


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_cleaning_judges_each_text_once(real):
    d = real("documents")
    cleaned, report = (
        f(d)._jdf.queryExecution().optimizedPlan().toString() for f in (quality.clean_documents, quality.quality_report)
    )
    assert cleaned.count("lambdafunction(") == report.count("lambdafunction(") > 0


def test_secret_spans_equal_plain_patterns(docs):
    random.seed(1)
    bits = ["token", "SECRET", "api_key", "=", ":", " ", '"', "'", "abc", "abcdef", "AKIA", "ABCDEFGH12345678", "é"]
    bits += ["\U0001f600", "0123456789abcdef", "aabbccdd", ".", "\n", "Token"]
    texts = [None, "", "token=token=abcdef", "secret=token: abcdefgh", "AKIA" * 8 + "é", "token=abcdefg " * 5000]
    texts += ["".join(random.choice(bits) for _ in range(random.randint(1, 14))) for _ in range(400)]
    rows = {r.doc_id: r for r in secrets.secret_digest(docs(texts)).collect()}
    for i, t in enumerate(texts):
        spans = base(t or "")
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert rows[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
    assert secrets.secret_digest(docs([])).count() == 0


def test_markov_models_tell_random_strings_from_identifiers(real):
    names = ["getUserAccountNumberById", "get_user_account_number", "internationalisation-of-things", "12345678901234567890"]
    keys = ["Zk3vQ9xLm2Rt7YbW8cPd", "x9+Kd/82hSLqpZ71mWc0=", "aB3+dE5/gH7iJ9kL1mN0oP2q"]
    d = real("documents").select("doc_id", "text")
    ratios = secrets.pair_ratios(secrets.labelled_samples(d))
    texts = [f"see {n} and go on" for n in names + keys]
    more = d.sparkSession.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], d.schema)
    rows = {r.doc_id - 10**6: r.spans for r in secrets.secret_digest(d.unionByName(more)).collect()}
    assert len(ratios) == 68**2
    for i, n in enumerate(names + keys):
        assert rows[i] == (f"markov:4:{4 + len(n)}" if n in keys else "")


def plain_ratio(ratios, value):
    """The summed ratio of a string's pairs, read off the table."""
    size, total, before = len(secrets.ALPHABET) + 1, 0.0, 0
    for c in value:
        total, before = total + ratios[before * size + secrets.ALPHABET.index(c) + 1], secrets.ALPHABET.index(c) + 1
    return total


def plain_markov(ratios, text):
    taken, out = base(text), []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text):
        free = not any(a < m.end() and m.start() < b for a, _, b in taken)
        ratio = plain_ratio(ratios, m[0])
        if free and re.search("[A-Za-z]", m[0]) and ratio >= max(secrets.MIN_RATIO, secrets.MIN_PER_CHAR * len(m[0])):
            out.append(f"markov:{m.start()}:{m.end()}")
    return out


def random_string(alphabet, length):
    return "".join(random.choice(alphabet) for _ in range(length))


ALPHABETS = {
    "hex": "0123456789abcdef", "upper hex": "0123456789ABCDEF", "base64": secrets.ALPHABET[:64],
    "letters and digits": secrets.ALPHABET[:62], "capitals and digits": secrets.ALPHABET[:26] + "0123456789",
}


def test_markov_spans_equal_a_plain_model(real):
    random.seed(6)
    d = real("documents").select("doc_id", "text")
    ratios = secrets.pair_ratios(secrets.labelled_samples(d))
    texts = [" é ".join(random_string(random.choice([*ALPHABETS.values(), "aeiourst_-"]), random.randint(15, 60)) for _ in range(6)) for _ in range(120)]
    texts.append("key wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY and 3F2504E04F8941D39A0C0305E82C3301AB")
    more = d.sparkSession.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], d.schema)
    table = d.unionByName(more)
    monkey = {r.doc_id: r.spans for r in secrets.secret_digest(table).collect()}
    own = secrets.pair_ratios(secrets.labelled_samples(table))
    for r in table.collect():
        found = [x for x in monkey[r.doc_id].split(",") if x.startswith("markov")]
        assert found == plain_markov(own, r.text or "")
    assert monkey[10**6 + 120].count("markov") == 2 and len(ratios) == len(own)


def test_held_out_error_rates(real):
    random.seed(7)
    d = real("documents").select("doc_id", "text")
    ratios = secrets.pair_ratios(secrets.labelled_samples(d.where("doc_id % 2 = 0")))
    judged = lambda v: plain_ratio(ratios, v) >= max(secrets.MIN_RATIO, secrets.MIN_PER_CHAR * len(v))
    held = secrets.labelled_samples(d.where("doc_id % 2 = 1")).where("not random and length(value) >= 20").collect()
    held = [r.value for r in held if set(r.value) <= set(secrets.ALPHABET) and re.search("[A-Za-z]", r.value)]
    assert len(held) > 300 and sum(map(judged, held)) <= 0.002 * len(held)
    for name, alphabet in ALPHABETS.items():
        for length, least in ((20, 0.9), (32, 0.97), (40, 0.98)):
            assert sum(judged(random_string(alphabet, length)) for _ in range(300)) >= least * 300, (name, length)


def test_running_sums_cross_blocks(spark):
    n = list(range(1, 301))
    row = spark.createDataFrame([(n,)], "x array<int>").select(secrets.running_sums(secrets.F.col("x"))).first()[0]
    assert row == [sum(n[: i + 1]) for i in range(len(n))]


def test_quality_query_equals_its_sql_twin(spark):
    import __spark_entry__ as entry
    from tests.llm.conftest import SF
    from tools.compare import differences, duck

    name = "op4_quality_rules"
    _, problem = differences(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name])
    assert problem is None
