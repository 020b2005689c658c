"""Personal data, prefix tries and spelling variants against plain rules on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import personal_data, prefix_tries, spelling_variants

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- personal data -----------------------------------------------------------------------


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    """The base rules as they are written, by the backtracking matcher."""
    out = []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def base_of(text):
    return [(s.kind, s.start, s.end) for s in personal_data.find_spans(text) if s.base]


def test_base_spans_equal_the_written_rules():
    rng = random.Random(3)
    pieces = ["1", "25", "255", "256", "0004", "4111111111111111", "4242 4242 4242 4242", "5500-0000-0000-0004", "7", "9" * 20]
    pieces += [".", "..", " ", "  ", "-", "+", "+1", "(", ")", "@", "@@", "a", "Bo.b", "x-y", "_%", "é", "日", ".com", "a@b.co", "@x.y.z", "\n", "1.2.3.4", ".5"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        assert base_of(text) == plain_spans(text), text


def test_added_spans_need_a_check_or_context():
    kinds = lambda t: [(s.kind, t[s.start : s.end]) for s in personal_data.find_spans(t) if not s.base]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 now") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("pay to DE88370400440532013000 now") == []
    assert kinds('é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"') == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    assert kinds('commit = "04dbebab91ab85687d33eeaaf9ac699e1188f962"') == []
    assert kinds("her social security number 219-09-9999") == [("ssn", "219-09-9999")]
    assert kinds("part 219-09-9999") == []
    # Two cards side by side are one run of digits: no base span, two added ones.
    both = "4111111111111111 5500-0000-0000-0004"
    assert base_of(both) == [] and kinds(both) == [("card", "4111111111111111"), ("card", "5500-0000-0000-0004")]


def test_context_moves_the_score():
    score = lambda t: personal_data.find_spans(t)[0].score
    assert score("host 10.0.0.1") > score("see 10.0.0.1") > score("version 10.0.0.1")


def test_hostile_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + " " * 300_000, "1 " * 150_000, "AB12" * 75_000):
        personal_data.find_spans(text)
    assert len(base_of("a@b.c " * 20_000)) == 20_000


def test_personal_data_frame(spark):
    rows = [(1, "mail é.a@b.co", "x"), (None, "10.0.0.1", "y"), (2, None, "z"), (3, "", "z"), (1, "mail é.a@b.co", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    found = personal_data.digest(personal_data.find_personal_data(docs)).collect()
    assert len(found) == 5
    by_spans = Counter((r.doc_id, r.spans, r.n_email, r.n_ip) for r in found)
    assert by_spans == {(1, "email:6:13", 1, 0): 2, (None, "ip:0:8", 0, 1): 1, (2, "", 0, 0): 1, (3, "", 0, 0): 1}
    assert {r.base_sha256 for r in found if r.doc_id == 1} == {hashlib.sha256(b"email:6:13").hexdigest()}
    assert {r.base_sha256 for r in found if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()}
    clean = {r.text for r in personal_data.find_personal_data(docs, redact=True).collect()}
    assert clean == {"mail é<email>", "<ip>", ""}
    assert personal_data.digest(personal_data.find_personal_data(docs.limit(0))).collect() == []


# --- prefix tries ------------------------------------------------------------------------


def plain_tree(rows):
    """Every prefix of every rebuilt conversation, by dictionaries."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(original):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        turns = tuple(original.get(base, [])[:h] + original[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, who in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(who) - 1) * len(WORD.findall(k[-1][1])) if k else 0
    return sorted(
        (
            who[0],
            len(k),
            members[k[:-1]][0] if k else None,
            len(who),
            children[k],
            leaves[k],
            saved[k],
            hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest(),
        )
        for k, who in members.items()
    )


CONVS = "conv_id bigint, turn bigint, role string, text string, depth string, n bigint"


def tree_of(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONVS)
    out = prefix_tries.prefix_tree(df, **sizes).collect()
    return sorted(tuple(r) for r in out)


def random_log(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        size = rng.choice([1, 2, 3, longest, rng.randrange(1, longest + 1)])
        same = rng.random() < 0.4
        for t in range(size):
            text = f"turn {t}" if same else f"{rng.randrange(2)} w {rng.randrange(3)}"
            rows.append((c * rng.choice([1, 1, 3]) if same else c, t, "user" if t % 2 else "assistant", text))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard": 5, "cell": 20}, {"shard": 40, "cell": 40}])
def test_prefix_tree_equals_dictionaries(spark, sizes):
    rows = random_log(1, 120, 9)
    assert tree_of(spark, rows, **sizes) == plain_tree(rows)


def test_prefix_tree_of_odd_rows(spark):
    rows = [(0, None, None, None), (0, 1, "user", "a  b\tc"), (0, 1, "user", "a  b\tc"), (0, 1, "", "z"), (None, 0, "user", "x")]
    rows += [(-7, 5, "user", "é\x0bf"), (-7, 4, None, ""), (41, 0, "user", "only"), (45, None, "user", "n"), (45, None, "user", "m"), (60, 3, "a", "b")]
    rows += [(61 + k, t, "user", "copy") for k in range(15) for t in range(1 + k % 3)]
    assert tree_of(spark, rows) == plain_tree(rows)
    assert tree_of(spark, rows, shard=2, cell=2) == plain_tree(rows)
    assert tree_of(spark, []) == []
    assert tree_of(spark, [(None, 1, "user", "x")]) == []


def test_prefix_tree_of_one_long_conversation(spark):
    rows = [(0, t, "user", f"w {t % 7}") for t in range(300)] + [(20, t, "user", f"w {t % 7}") for t in range(290)]
    rows += [(40 + k, 0, "user", "w 0") for k in range(30)]
    assert tree_of(spark, rows, shard=64, cell=256) == plain_tree(rows)


def test_double_array_finds_its_sequences_and_no_others():
    rng = np.random.default_rng(5)
    sequences = [tuple(rng.integers(0, 30, rng.integers(1, 8))) for _ in range(400)]
    codes, offsets = np.concatenate(sequences), np.r_[0, np.cumsum([len(s) for s in sequences])]
    trie = prefix_tries.DoubleArray(codes, offsets)
    slots = trie.walk(codes, offsets)
    named = {}
    for i, s in enumerate(sequences):
        for d in range(len(s)):
            assert named.setdefault(s[: d + 1], slots[offsets[i] + d]) == slots[offsets[i] + d] > 0
    assert len(set(named.values())) == len(named)
    others = [s for s in {tuple(rng.integers(0, 30, 4)) for _ in range(300)} if s not in named]
    codes, offsets = np.concatenate(others), np.r_[0, np.cumsum([4] * len(others))]
    assert (trie.walk(codes, offsets)[offsets[1:] - 1] == -1).all()


# --- spelling variants -------------------------------------------------------------------


def plain_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, some in close.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(close[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def misspelt(seed):
    rng = random.Random(seed)
    stems = ["president", "presidents", "pressident", "straßenbahn", "théâtres", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "bababab"]
    rows = []
    for doc in range(300):
        words = []
        for _ in range(rng.randrange(12)):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abéÀ") + w[k + 1 :], w[:k] + rng.choice("asé") + w[k:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((doc if doc % 50 else None, rng.choice([" ", ", ", "’", "日"]).join(words)))
    rows += [(k, "president " * 150 + "presidemt presidemt") for k in range(12)]
    return [*rows, (7, None), (8, ""), (9, "x" * 90 + " " + "x" * 91), (10, "x" * 90 + " " + "x" * 91), (11, "x÷×yzabc x÷×yzabc")]


@pytest.mark.parametrize("sizes", [{}, {"hot": 3, "cell": 16}, {"hot": 1, "cell": 100}])
def test_spelling_variants_equal_brute_force(spark, sizes):
    rows = misspelt(2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    got = sorted(tuple(r) for r in spelling_variants.spelling_variants(docs, **sizes).collect())
    expected = plain_variants(rows)
    assert got == expected
    assert any(form for _, form, *_ in expected) and any(w != r for w, _, r, *_ in expected)


def test_very_long_words(spark):
    a, b = "x" * 5000, "x" * 3000 + "y" + "x" * 2000
    docs = spark.createDataFrame([(1, f"{a} {b}"), (2, f"{b} {a}")], "doc_id bigint, text string")
    assert {(r.word, r.n_near) for r in spelling_variants.spelling_variants(docs).collect()} == {(a, 1), (b, 1)}


def test_spelling_variants_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling_variants.spelling_variants(docs).collect() == []


def test_words_are_counted_in_parts(spark):
    rows = misspelt(4)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = {(r.word, r.n) for r in spelling_variants.count_words(docs).collect()}
    assert {(r.word, r.n) for r in spelling_variants.count_words(docs, shipped=5).collect()} == whole
