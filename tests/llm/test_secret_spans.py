"""Added spans against brute force, and the battery under both hypotheses."""

import math
import random
import re

import numpy as np

from cairn.llm import secrets

KEYS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


LETTERS, OFTEN = "etaoinshrdlucmfwypvbgkjqxz", range(100, 48, -2)


def written(rng, n):
    """Letters as often as text has them."""
    return "".join(rng.choices(LETTERS, [f * f for f in OFTEN], k=n))


def rows(seed=9):
    rng = random.Random(seed)
    text = lambda n: " ".join(written(rng, rng.randint(2, 9)) for _ in range(n))
    draw = lambda kind, n: "".join(rng.choice(secrets.ALPHABETS[kind]) for _ in range(n))
    out = [(i, f"{text(90)} {draw('base64', rng.choice((22, 40, 64, 120)))} {text(9)}") for i in range(25)]
    out += [(100 + i, f"id {draw('base32', 56)}, sum {draw('hex', 64).upper()}; word {'internationalization' * rng.randint(1, 3)}") for i in range(15)]
    out += [(200 + i, " ".join(written(rng, rng.randint(20, 40)) for _ in range(4))) for i in range(20)]
    return out + [(300, "token = " + draw("base64", 44) + " and " + draw("hex", 40)), (301, None), (302, ""), (303, "=" * 50 + "1" * 40), (304, "x" * 30_000), (305, "é" + draw("alnum", 60))]


def brute(rows):
    """Every candidate's p-value among runs of text, then the step-up rule over each encoding and length class."""
    letters = {}
    for _, text in rows:
        for c in re.sub(r"[A-Za-z0-9+/_=-]{20,}", "", text or ""):
            if c in KEYS:
                letters[c] = letters.get(c, 0) + 1
    nulls = secrets.null_figures(letters)
    found = []
    for doc, text in rows:
        covered = {i for a, b, _ in secrets.base_spans(text or "") for i in range(a, b)}
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
            run = m[0].rstrip("=")
            kind = secrets.encoding_of(run) if len(run) >= 20 else None
            if kind and not covered & set(range(*m.span())):
                least = max(k for k, c in enumerate(secrets.CLASSES) if len(run) >= c)
                null = nulls[kind, least]
                p = (1 + sum(1 for x in null if x >= secrets.randomness(run, kind))) / (1 + len(null))
                found.append((kind, least, math.floor(-math.log10(p) / secrets.BIN), doc, m.span()))
    out = set()
    for cls in {f[:2] for f in found}:
        own = sorted((f for f in found if f[:2] == cls), key=lambda f: -f[2])
        bounds = [b for i, f in enumerate(own, 1) for b in [f[2]] if (i == len(own) or own[i][2] < b) and 10 ** (-b * secrets.BIN) * len(own) <= secrets.FDR * i]
        out |= {(f[3], *f[4]) for f in own if bounds and f[2] >= min(bounds)}
    return out


def added(df):
    return {(r.doc_id, s.start, s.end) for r in secrets.scan(df).collect() for s in r.added}


def test_added_spans_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(secrets, "DRAWS", 5000)
    given = rows()
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    want = brute(given)
    assert added(docs) == want
    texts = dict(given)
    keys = {(d, a, b) for d, a, b in want if d < 100 and b - a >= 40} | {(d, a, b) for d, a, b in want if 100 <= d < 200 and b - a >= 56}
    assert len(keys) >= 28 and len([w for w in want if 200 <= w[0] < 300]) <= 2 and not [w for w in want if "international" in texts[w[0]][w[1] : w[2]]]
    got = {r.doc_id: r for r in secrets.secret_spans(docs).collect()}
    for doc, row in got.items():
        spans = [s.split(":") for s in row.spans.split(",") if s]
        assert {(int(a), int(b)) for k, a, b in spans if k == "random"} == {(a, b) for d, a, b in want if d == doc}
        assert spans == sorted(spans, key=lambda s: (int(s[1]), secrets.KINDS.index(s[0]))) and row.n_random == len([r for r in row.ratios.split(",") if r])


def test_many_runs_get_the_figures_of_each():
    rng = np.random.default_rng(2)
    for kind, n in (("hex", 20), ("base32", 33), ("alnum", 48), ("base64", 96)):
        alphabet = secrets.ALPHABETS[kind]
        x = rng.integers(0, len(alphabet), (60, n))
        x[:5] = x[:5, :1]  # one symbol alone
        figures = secrets.battery(x, len(alphabet))
        assert np.allclose(figures, [secrets.randomness("".join(alphabet[v] for v in row), kind) for row in x], rtol=1e-9)


def test_text_reaches_its_own_p_values_as_often_as_they_say():
    letters = {c: n**4 for c, n in zip(LETTERS, OFTEN)}  # as uneven as a language
    nulls = secrets.null_figures(letters)
    rng = np.random.default_rng(7)
    weight = np.array([letters.get(c, 0) + 1 for c in secrets.ALPHABETS["alnum"]], float)
    for k, length in enumerate(secrets.CLASSES[:3]):
        figures = secrets.battery(rng.choice(36, (4000, length), p=weight / weight.sum()), 36)
        p = np.array([secrets.text_p(f, nulls["alnum", k]) for f in figures])
        assert abs((p <= 0.1).mean() - 0.1) < 0.02 and (p <= 0.01).mean() < 0.02
    # a random run of the same length is told apart, the better the longer it is
    power = [np.mean([secrets.text_p(f, nulls["alnum", k]) <= 0.001 for f in secrets.battery(rng.integers(0, 36, (400, n)), 36)]) for k, n in enumerate(secrets.CLASSES)]
    assert power == sorted(power) and power[-1] > 0.95


def test_spans_are_met_in_order():
    taken = secrets._merged([(5, 9, "hex"), (1, 3, "hex"), (8, 12, "assign"), (20, 30, "hex")])
    assert taken == ([1, 5, 20], [3, 12, 30])
    for a, b in [(0, 1), (3, 5), (12, 20), (30, 40)]:
        assert not secrets._meets(taken, a, b)
    for a, b in [(0, 2), (2, 4), (4, 6), (11, 13), (0, 40), (25, 26)]:
        assert secrets._meets(taken, a, b)
