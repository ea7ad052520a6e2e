"""Duplicates, personal data, mixing and the classifiers against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from brute import base_sha, base_spans

from tidelog.llm import embed_near, linededup, mixing, pii, quality, simhash, toxicity
from tidelog.llm.common import written
from tidelog.llm.graph import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}" if i % 5 else None, 1.5, 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, h long, spans string")


def smallest(n, links):
    label = list(range(n))
    while True:
        new = label[:]
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 450)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long"), "t").collect()}
    label = smallest(450, links)
    assert got == {i: label[i] for a, b in links if a != b for i in (a, b)}
    assert connected_components(spark.createDataFrame([], "u long, v long"), "t").count() == 0


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_cover_guarantee():
    cover, rng = simhash.masks(), random.Random(1)
    assert len(cover) == 31
    for _ in range(3000):
        x = sum(1 << i for i in rng.sample(range(64), 4))
        assert any(not x & m for m in cover)
    for m in cover:
        assert sum(simhash.segments(m, 4)) | m == (1 << 64) - 1


@pytest.mark.parametrize("most", [3, 20_000])
def test_links_find_every_pair(spark, most):
    rng = random.Random(4)
    f = {rng.getrandbits(64) for _ in range(100)}
    for x in list(f)[:10]:
        for _ in range(25):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
            f.add(x)
    f = sorted(f)
    df = spark.createDataFrame([(simhash._signed(x), i) for i, x in enumerate(f)], "fp long, rep long")
    cc = {r.node & (2**64 - 1): r.component for r in connected_components(simhash.links(df, most=most), "t").collect()}
    label = smallest(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    groups = {}
    for i, x in enumerate(f):
        groups.setdefault(label[i], set()).add(cc.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


TEXTS = [None, "", "a b c", "A B C", "one two three four five six", "one two three four five six", "  ", "Ünï cödé ÀB", "x " * 40_000]


def test_op7(spark):
    got = {r.doc_id: r for r in simhash.op7_simhash(docs(spark, TEXTS)).collect()}
    f = [plain_fingerprint(t) for t in TEXTS[:-1]]
    for i, x in enumerate(f):
        assert got[i].fingerprint == f"{x:016x}"
    label = smallest(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    assert [got[i].component_id for i in range(len(f))] == label
    kept = simhash.keep_one(docs(spark, TEXTS + ["a b c"], [*range(len(TEXTS)), None]))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 2, 4, 7, 8] and kept.columns == docs(spark, []).columns
    assert simhash.op7_simhash(docs(spark, TEXTS).limit(0)).count() == 0


def test_keep_one_by_row(spark):
    rows = docs(spark, ["alpha beta gamma delta epsilon", "one two three four five six", "one two three four five six", "zeta eta", "zeta eta", "theta iota", "theta iota"], [1, 1, 2, None, None, 7, 7])
    got = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(rows.select("doc_id", "text", "lang", "score")).collect())
    assert got == [(0, "zeta eta"), (1, "alpha beta gamma delta epsilon"), (1, "one two three four five six"), (7, "theta iota")]


def test_mix_rows_by_row(spark):
    rows = spark.createDataFrame([(1, "a b c", "x", 1), (1, "d e f", "y", 1), (None, "g h i", "x", 2), (None, "j k l", "z", 3)], "doc_id long, text string, source string, size int")
    mixed = mixing.mix(rows, carry=["text"]).collect()
    want = Counter({(r.doc_id, r.source, r.text): r.repeats for r in mixed if r.repeats})
    got = Counter((r.doc_id, r.source, r.text) for r in mixing.mix_rows(rows).collect())
    assert got == want and mixing.mix_rows(rows).columns == rows.columns


def test_op3(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    rows = [(i, base[i].tolist()) for i in range(60)]
    for k in range(120):  # near copies of ten of them
        rows.append((100 + k, (base[k % 10] * rng.uniform(0.5, 2) + rng.standard_normal(16) * 0.08).tolist()))
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [0.0] * 16), (304, [float("nan")] * 16), (305, [None] * 16), (306, []), (307, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed_near.op3_projection_passes(df).collect()}
    ok = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i < 302]
    near = np.array([[a @ b for _, b in ok] for _, a in ok]) >= 0.9
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i, _ in ok] == near.sum(axis=1).tolist()
    label = smallest(len(ok), list(zip(*np.nonzero(near), strict=True)))
    assert [got[i].component_id for i, _ in ok] == [ok[label[k]][0] for k in range(len(ok))]
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(302, 308)) and len(got) == len(rows)
    assert embed_near.op3_projection_passes(df.limit(0)).count() == 0


def test_op3_edges(spark):
    """Repeated rows of one vec_id, copies, extra columns of clashing names, a pair just at the threshold and one just below."""
    at, below = np.array([0.9, np.sqrt(1 - 0.81)]), np.array([0.8999, np.sqrt(1 - 0.8999**2)])
    v = [[1.0, 0.0], at.tolist(), [0.0, -1.0], [-0.0, -2.0]]
    up = float(np.nextafter(0.9, 1))
    v[1] = [up, float(np.sqrt(1 - up**2))]
    rows = [(1, v[0], 5, 7, "a"), (2, v[1], 5, 7, "b"), (3, v[2], 5, 7, "c"), (4, v[3], 5, 7, "d"), (5, [0.0, -1.0], 1, 1, "e"), (5, [0.0, -1.0], 1, 1, "e"), (6, (-below).tolist(), 0, 0, "f"), (7, [-1.0, 0.0], 0, 0, "g"), (None, [1.0, 0.0], 0, 0, "h")]
    got = embed_near.op3_projection_passes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int, id long, component_id string")).collect()
    of = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert len(got) == 9 and of[1] == (2, 1) and of[2] == (2, 1) and of[None] == (2, 1) and of[3] == of[4] == of[5] == (3, 3)
    assert of[6] == (0, 6) and of[7] == (0, 7)


def test_op3_hot_topic(spark):
    """A third of the vectors share a cosine of 0.8; pairs of 0.9 to 0.93 lie inside that third."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    n, hot, d, pairs = 12_000, 4000, 64, 300
    x = unit(rng.standard_normal((n, d)))
    c = unit(rng.standard_normal(d))
    away = unit(x[:hot] - (x[:hot] @ c)[:, None] * c)
    x[:hot] = np.sqrt(0.8) * c + np.sqrt(0.2) * away
    goal = rng.uniform(0.9, 0.93, pairs)
    other = unit(rng.standard_normal((pairs, d)))
    for v in (np.broadcast_to(c, other.shape), away[:pairs]):
        other -= (other * v).sum(axis=1, keepdims=True) * v
    inner = (goal - 0.8) / 0.2
    mates = np.sqrt(0.8) * c + np.sqrt(0.2) * (inner[:, None] * away[:pairs] + np.sqrt(1 - inner**2)[:, None] * unit(other))
    x = np.r_[x, mates]
    got = {r.vec_id: r.n_links for r in embed_near.op3_projection_passes(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).collect()}
    y = unit(x)
    true = (y @ y.T >= 0.9).sum(axis=1) - 1
    assert true.sum() >= 2 * 0.95 * pairs and sum(got.values()) >= 0.995 * true.sum() and all(got[i] <= true[i] for i in got)


PII = [None, "", "a@b.c._x@d.e x@y.z.w", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 00000.0.0.0", " é 𝒳 4111 1111 1111 1111 x 4111-1111-1111-1112", "+1 (599) 555-3756 and +49 30 1234567 and +1 2", "9" * 20_000, "a" * 20_000 + "@b.c", "+" * 50 + "1" * 9 + " +1((((((2", "x.y@-.- é@é.com a%+b@c.d", "12 34 5678 9012 3456 78", "1.2.3.400 1.2.3.4"]


def test_op4(spark):
    got = {r.doc_id: r for r in pii.op4_weak_supervision(docs(spark, PII)).collect()}
    for i, t in enumerate(PII):
        n = Counter(k for k, _, _ in base_spans(t or ""))
        assert got[i].base_sha256 == base_sha(t or "") and (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(n[k] for k in pii.KINDS)
        assert {f"{k}:{a}:{b}" for k, a, b in base_spans(t or "")} <= set(got[i].spans.split(","))
    real = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in real.collect()}
    assert all(r.base_sha256 == base_sha(texts[r.doc_id]) for r in pii.op4_weak_supervision(real).collect())
    assert pii.op4_weak_supervision(docs(spark, PII).limit(0)).count() == 0


def test_op4_many_matches(spark):
    t = ", ".join(f"{10 + i % 90} a{i}@b.co +1 (599) 555-{1000 + i % 9000}" for i in range(25_000))
    (r,) = pii.op4_weak_supervision(docs(spark, [t, t]).limit(1)).collect()
    assert r.n_email == r.n_phone == 25_000 and r.base_sha256 == base_sha(t)
    (m,) = pii.mask(docs(spark, [t])).collect()
    assert m.text.count("[EMAIL]") == m.text.count("[PHONE]") == 25_000 and "@" not in m.text and m.text.endswith(" [EMAIL] [PHONE]")


def test_op4_added_spans(spark):
    loose = {k: re.compile(p) for k, p in pii.LOOSE.items()}
    texts = ["please write to bob [at] mail [dot] com today", "call me: 555-123-4567 or mail x@y.org", "version 123-456-7890", "card 3782 822463 10005 is mine", "2001:0db8:85a3:0000:0000:8a2e:0370:7334 host", "phone +1 (599) 555-3756", "reach ann(at)site.com"] * 3
    added = 0
    for r in pii.op4_weak_supervision(docs(spark, texts)).collect():
        base = {(k, a, b) for k, a, b in base_spans(texts[r.doc_id])}
        spans = {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)}
        assert base <= spans
        for k, a, b in spans - base:
            assert any((m.start(), m.end()) == (a, b) for m in loose[k].finditer(texts[r.doc_id])) and all(b <= p or q <= a for _, p, q in base)
            added += 1
    assert added >= 6


def test_op4_estimates_reliabilities():
    """Simulated labelers: the posteriors equal a plain EM item by item, and tell the truth better than a vote does."""
    rng = random.Random(5)
    right = (0.95, 0.9, 0.6, 0.55, 0.6)
    items = []
    for _ in range(3000):
        y = rng.random() < 0.5
        items.append((y, ("email", *((1 if y == (rng.random() < p) else 2) for p in right), 1)))
    patterns = sorted(Counter(p for _, p in items).items())
    post = dict(zip([p for p, _ in patterns], pii.estimate([(*p, n) for p, n in patterns]), strict=True))
    own = [1 / (1 + np.exp(-(sum(1 if v == 1 else -1 for v in p[1:6]) - 1.5))) for _, p in items]
    for _ in range(200):
        share = (sum(own) + 1) / (len(own) + 2)
        odds = [np.log(share / (1 - share))] * len(items)
        for j in range(5):
            yes, no = [2.0, 4.0, 1.0], [2.0, 1.0, 4.0]
            for w, (_, p) in zip(own, items, strict=True):
                yes[p[1 + j]] += w
                no[p[1 + j]] += 1 - w
            odds = [o + np.log(yes[p[1 + j]] / sum(yes) / (no[p[1 + j]] / sum(no))) for o, (_, p) in zip(odds, items, strict=True)]
        new = [1 / (1 + np.exp(-o)) for o in odds]
        if max(abs(a - b) for a, b in zip(new, own, strict=True)) < 1e-9:
            break
        own = new
    assert max(abs(post[p] - w) for w, (_, p) in zip(new, items, strict=True)) < 1e-6
    by_em = np.mean([(post[p] > 0.5) == y for y, p in items])
    assert by_em > np.mean([(sum(v == 1 for v in p[1:6]) >= 3) == y for y, p in items]) and by_em > 0.9


def test_mask(spark):
    masked = pii.mask(docs(spark, [None, "mail a@b.com or +1 (599) 555-3756.", "clean text 42", "reach bob [at] mail [dot] com"]))
    assert masked.columns == docs(spark, []).columns
    assert [r.text for r in masked.orderBy("doc_id").collect()][:3] == [None, "mail [EMAIL] or [PHONE].", "clean text 42"]


def test_op5(spark):
    rng = random.Random(6)
    texts = [None if k % 17 == 0 else " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 80))) for k in range(300)]
    got = mixing.op5_water_filling(docs(spark, texts)).collect()
    size = [len(WORD.findall(t or "")) for t in texts]
    source = {i: f"s{i % 3}" if i % 5 else None for i in range(300)}
    sums = Counter()
    for i, n in enumerate(size):
        sums[source[i]] += n
    names = sorted((s for s in sums if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, free, left = {}, set(names), 1.5 * sum(size)
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sums[s]]
        if not over:
            break
        for s in over:
            goal[s] = 2.0 * sums[s]
            left -= goal[s]
            free.discard(s)
    goal |= {s: weight[s] * level for s in free}
    taken = Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == sums[source[r.doc_id]] and abs(r.target - goal[source[r.doc_id]]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert len(got) == 300 and all(abs(taken[s] - goal[s]) <= 1 for s in names)
    again = mixing.op5_water_filling(docs(spark, texts).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    rows = mixing.mix_rows(docs(spark, texts))
    assert rows.columns == docs(spark, []).columns and max(Counter(r.doc_id for r in rows.collect()).values()) <= 2
    assert mixing.op5_water_filling(docs(spark, texts).limit(0)).count() == 0


def test_op9(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(9)) + "."
    shared = " ".join(sentence() for _ in range(7))
    own = [" ".join(sentence() for _ in range(4)) for _ in range(6)]
    texts = [own[0] + " " + shared + " " + own[1], own[2] + "\n" + shared.upper().replace(" ", "  ") + "\n" + own[3], own[4], own[4], None, "", own[5] + " Yes. Yes."]
    got = {r.doc_id: r for r in linededup.op9_line_dedup(docs(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[2].text == own[4] and got[6].text == texts[6]
    assert got[1].text == own[2] + "\n" + own[3] and got[1].removed == f"{len(own[2]) + 1}:{len(texts[1]) - len(own[3])}"
    assert got[3].text == "" and got[3].kept == "" and got[4].text is None and got[5].text == ""
    assert linededup.op9_line_dedup(docs(spark, texts).limit(0)).count() == 0
    real = spark.read.parquet(f"{SF}/documents.parquet")
    expected = plain_removals([(r.doc_id, r.text) for r in real.collect()])
    for r in linededup.op9_line_dedup(real).collect():
        assert r.removed == ",".join(f"{a}:{b}" for a, b in expected[r.doc_id])


def plain_units(text):
    """(start, start of what follows, words) of every line, sentence and stretch, one after the other."""
    edges = [m.span() for m in re.finditer(r"\S+", text)]
    w = [text[a:b].lower() for a, b in edges]
    after = [a for a, _ in edges[1:]] + [len(text)]
    line = [text.count("\n", 0, a) for a, _ in edges]
    sentence = [sum(line[i] != line[i - 1] or w[i - 1][-1] in ".!?" for i in range(1, k + 1)) for k in range(len(w))]
    out = []
    for kind, mark in (("line", line), ("sentence", sentence)):
        for x in sorted(set(mark)):
            own = [k for k, y in enumerate(mark) if y == x]
            if len(own) >= linededup.UNIT_WORDS:
                out.append((own[0], own[-1], kind))
    h = [xxhash.xxh3_64_intdigest(x.encode()) for x in w]
    pair = [((x ^ x >> 29) * linededup._BASES[0] + y) % 2**64 for x, y in zip(h, h[1:])]
    anchors = sorted({p for i in range(len(pair) - linededup.GAP + 1) for p in range(i, i + linededup.GAP) if pair[p] == min(pair[i : i + linededup.GAP])})
    for a in anchors:
        z = next((p for p in anchors if p >= a + linededup.STRETCH), None)
        if z is not None:
            out.append((a, z, "stretch"))
    return [(edges[a][0], after[z], (kind, *w[a : z + 1])) for a, z, kind in out]


def plain_removals(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        own, spans, run = {}, [], []
        found = plain_units(t or "")
        for a, z, key in sorted(found, key=lambda x: x[0]):
            goes = key in seen or key in own
            if key[0] == "sentence":
                if goes:
                    run.append((a, z, len(key) - 1))
                if run and (not goes or key is max((x for x in found if x[2][0] == "sentence"), key=lambda x: x[0])[2]):
                    if sum(n for _, _, n in run) >= linededup.RUN_WORDS:
                        spans.append((run[0][0], run[-1][1]))
                    run = []
            elif key in seen:
                spans.append((a, z))
            elif key in own:
                spans.append((max(a, own[key]), z))
            own.setdefault(key, z)
        seen |= set(own)
        gone = sorted({p for a, z in spans for p in range(a, z)})
        held = set(gone)
        firsts, lasts = [p for p in gone if p - 1 not in held], [p + 1 for p in gone if p + 1 not in held]
        out[i] = list(zip(firsts, lasts, strict=True))
    return out


def test_op9_edges(spark):
    line = "one line of several words that two documents share in full"
    rows = docs(spark, [line, line + "\nown words stay here", line, "x", None, line], [1, 2, 2, 2, None, None])
    got = sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in linededup.op9_line_dedup(rows).collect())
    n = len(line)
    assert got == [(0, "", 0), (0, line, 0), (1, line, 0), (2, "", n), (2, "own words stay here", n + 1), (2, "x", 0)]
    long = " ".join(f"w{k}" for k in range(300_000))
    got = {r.doc_id: r.n_removed for r in linededup.op9_line_dedup(docs(spark, [long, "y " + long])).collect()}
    assert got[0] == 0 and got[1] > 0.99 * len(long)


def test_op9_passages_inside_sentences(spark):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    texts, planted = [], {}
    for k in range(40):
        passage = words(rng.randrange(51, 90))  # no sentence ends inside or around it
        texts += [f"{words(30)} {passage} {words(25)}.", f"{words(13)} {passage.upper()}\n{words(40)}. {words(9)} {passage}"]
        planted[2 * k + 1] = passage
    short = "a short line here to tell"  # goes, but is no passage
    texts += [f"{words(20)}\n{short}\n{words(8)}.", f"{words(12)}\n{short.upper()}\n{words(8)}.", f"{words(8)} {short} {words(8)}."]
    got = {r.doc_id: r for r in linededup.op9_line_dedup(docs(spark, texts)).collect()}
    left = [len(set(p.split()) & set(got[i].text.lower().split())) for i, p in planted.items()]
    assert all(n <= 4 * (linededup.GAP + 1) for n in left)  # at both ends of both copies
    assert sum(left) < 0.25 * sum(len(p.split()) for p in planted.values())
    assert all(got[i].n_removed == 0 for i in (*range(0, 80, 2), 80, 82)) and got[81].text.count("\n") == 1 and short.upper() not in got[81].text
    assert got[81].n_removed > 0 == got[81].n_passage_removed and all(got[i].n_passage_removed > 0.5 * len(p) for i, p in planted.items())
    one, none = "again " * 300, np.zeros(0, np.int64)
    assert all(a >= 17 * 6 for a, _ in linededup.removals([one], none, none)[1][0])


def area(scores, labels):
    """The share of (1, 0) pairs that the scores put in order."""
    one, none = [x for x, y in zip(scores, labels, strict=True) if y], [x for x, y in zip(scores, labels, strict=True) if not y]
    return sum((a > b) + (a == b) / 2 for a in one for b in none) / (len(one) * len(none))


@pytest.mark.parametrize("op,column,mod,rest", [(quality.op10_compression_quality, "quality", 3, 1), (toxicity.op2_kneser_ney, "toxic", 5, 0)])
def test_classifiers(spark, op, column, mod, rest):
    sf = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    extra = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "Z" * 50_000, "en", "s", 0), (-3, "Z" * 50_000, "en", "s", 0)], d.schema)
    clashing = d.unionByName(extra).selectExpr("*", "'x' AS score", "1 AS predicted", "2 AS held_out", "3 AS y", "4 AS part", "5 AS quality", "6 AS toxic")
    rows = op(clashing, lab).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == d.count() + 4 and got[-1].score == got[-2].score and len({r.score for r in rows if r.doc_id == -3}) == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % mod == rest) for i, r in got.items())
    truth = [(got[r.doc_id], r[column]) for r in lab.collect() if got[r.doc_id].held_out]
    assert area([r.score for r, _ in truth], [y for _, y in truth]) > 0.95
    assert np.mean([r.predicted == y for r, y in truth]) > 0.95 and min(np.mean([r.predicted == c for r, y in truth if y == c]) for c in (0, 1)) > 0.7
    some = d.limit(300)
    empty = op(some, lab.limit(0)).agg({"score": "max"}).first()[0]
    assert 0 <= empty <= 1 and op(d.limit(0), lab).count() == 0


def test_quality_is_the_difference_of_sizes(spark):
    """The score from zstandard alone, text by text, with the fitted dictionaries."""
    import zstandard

    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = quality.fit(d, lab)
    pack = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(x)) for x in (m.good, m.bad)]
    text = {r.doc_id: (r.text or "").encode() for r in d.collect()}
    for r in quality.op10_compression_quality(d, lab).collect():
        raw = text[r.doc_id]
        good, bad = (len(p.compress(raw)) for p in pack)
        assert abs(r.score - 1 / (1 + np.exp(-(m.weight * (bad - good) / max(len(raw), 1) + m.bias)))) < 1e-9
    assert m.weight > 0


def test_labelled_sample_is_bounded(spark):
    d = spark.createDataFrame([(i, "x" * 1000) for i in range(400)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = quality.labelled_texts(d, lab, "quality", 1000, quality.held_out(), most=50_000).collect()
    assert 0 < len(got) and max(Counter(r.y for r in got).values()) <= 25 and all(len(r.text) == 1000 for r in got)
    assert max(Counter(r.y for r in quality.labelled_texts(d, lab, "quality", 7, quality.held_out()).collect()).values()) == 14


def plain_kneser_ney(rows, corpus):
    """P(w | v) of both classes by the formula, from sets of triples."""
    D = toxicity.D
    tri = {y: {x for c, t in rows if c == y for w in [["^", "^", *toxicity.tokens(t)]] for x in zip(w, w[1:], w[2:])} for y in (0, 1)}
    pair = {y: Counter((b, c) for _, b, c in tri[y]) for y in tri}
    word = {y: Counter(c for _, c in pair[y]) for y in tri}
    kept = {w for y in tri for w, n in word[y].items() if n > D}
    told = {k for y in tri for k, n in pair[y].items() if n > D}
    vocabulary = kept | {w for k in told for w in k}
    docs_with = Counter(w for t in corpus for w in set(toxicity.tokens(t)))
    size = {w: docs_with[w] + 0.5 for w in vocabulary}
    unknown = sum(docs_with.values()) - sum(docs_with[w] for w in vocabulary) + 0.5
    every = sum(size.values()) + unknown

    def p(y, v, w):
        total = sum(word[y].values())
        shared = (size[w] if w in vocabulary else unknown) / every
        one = max(word[y][w] - D, 0) / total * (w in vocabulary) + sum(min(n, D) for n in word[y].values()) / total * shared
        mine = {k: n for k, n in pair[y].items() if k[0] == v}
        if not mine or not any(k[0] == v for k in told):
            return one
        h = sum(mine.values())
        return max(pair[y][v, w] - D, 0) / h * ((v, w) in told) + sum(min(n, D) for n in mine.values()) / h * one

    return vocabulary, p


def test_kneser_ney_probabilities(spark):
    rng = random.Random(11)
    bad = ["vile", "rot"]
    rows = [(y, " ".join(rng.choice(bad) if y and rng.random() < 0.2 else f"w{int(rng.paretovariate(1))}" for _ in range(30))) for y in [0] * 60 + [1] * 40]
    corpus = [t for _, t in rows] + ["w1 w2 vile other", None, ""]
    m = toxicity.count(spark.createDataFrame(rows, "y int, text string"), spark.createDataFrame([(t,) for t in corpus], "text string"))
    vocabulary, p = plain_kneser_ney(rows, corpus)
    assert set(m.ids) == vocabulary and {"vile", "rot"} <= vocabulary and len(m.keys) > 1
    names = sorted(vocabulary, key=m.ids.get)
    for v in [*names[:25], "never"]:
        got = m.probabilities(np.full(len(names) + 1, m.ids.get(v, 0)), np.arange(len(names) + 1))
        assert np.allclose(got.sum(axis=1), 1)
        for y in (0, 1):
            assert np.allclose(got[y], [p(y, v, w) for w in ["never", *names]])
    a, b = m.features("vile w1 rot"), m.features("w1 w2 w1")
    assert a[0] > b[0] and a[1] > b[1] and m.features("") == m.features(None) == [0.0, 0.0]


def test_pipeline(spark):
    """Every stage over its own input against a plain version."""
    import corpus_pipeline as c
    from tidelog.llm.tokens import encoder
    from tidelog.llm.queries import tokenizer_path

    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, None, None, None), (900_002, "", "en", None, 0), (900_003, "mail bob@site.org", "en", "src1", 1), (900_003, "mail bob@site.org", "en", "src1", 1), (None, "no id here, call +1 (599) 555-3756 now", "en", "src2", 1), (900_004, "word " * 30_000, "en", "src0", 1)], docs_.schema)
    now = written(docs_.unionByName(odd), "t-start")
    stages = dict(c.STAGES)
    rows = lambda df: [tuple(r) for r in df.collect()]

    kept = written(stages["quality"](spark, now, SF), "t-quality")
    m = quality.fit(now, spark.read.parquet(f"{SF}/labels.parquet"))
    pair = quality.compressors(m.good, m.bad)
    assert Counter(rows(kept)) == Counter(r for r in rows(now) if m.weight * quality.difference(pair, r[1]) + m.bias >= 0)
    assert 0 < kept.count() < now.count()

    one = written(stages["near_duplicates"](spark, kept, SF), "t-near")
    before = rows(kept)
    f = [plain_fingerprint(r[1]) for r in before]
    label = smallest(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    groups = {}
    for g, r in zip(label, before, strict=True):
        groups.setdefault(g, []).append(r)
    rank = lambda r: (r[0] is None, r[0] or 0)
    after = rows(one)
    assert len(after) == len(groups) and all(any(r in g and rank(r) == min(map(rank, g)) for g in groups.values()) for r in after)

    clear = written(stages["personal_data"](spark, one, SF), "t-pii")
    was = Counter((r[0], *r[2:]) for r in after)
    assert Counter((r[0], *r[2:]) for r in rows(clear)) == was and not any(base_spans(r[1] or "") for r in rows(clear) if "[" not in (r[1] or ""))
    text = {r[0]: r[1] for r in rows(clear)}
    assert all(text[r[0]] == r[1] for r in after if not re.search(r"[0-9@\[({:]", r[1] or "")) and all("@site.org" not in (t or "") for t in text.values())

    mixed = written(stages["mixing"](spark, clear, SF), "t-mix")
    goal = {r.source: (r.target, r.source_size) for r in mixing.mix(clear).select("source", "target", "source_size").distinct().collect()}
    words, most = Counter(), Counter()
    for r in rows(mixed):
        words[r[3]] += len(WORD.findall(r[1] or ""))
    for r in rows(clear):
        most[r[3]] = max(most[r[3]], len(WORD.findall(r[1] or "")))
    assert all(abs(words[s] - t) <= most[s] for s, (t, _) in goal.items()) and set(rows(mixed)) <= set(rows(clear))

    e = encoder(tokenizer_path("word_bpe_49k.json"))
    packed = stages["packing"](spark, mixed, SF).collect()
    want = Counter((r[0], k, len(x) // 4, zlib.crc32(x)) for r in rows(mixed) for ids in [e._whole(r[1] or "") + b"\1\0\0\0"] for k, x in enumerate(ids[a : a + 16384] for a in range(0, len(ids), 16384)))
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed) == want
    held = {}
    for r in packed:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(v)[k][0] == sum(n for _, n in sorted(v)[:k]) for v in held.values() for k in range(len(v))) and max(sum(n for _, n in v) for v in held.values()) <= 4096
    nothing = now.limit(0)
    for _, stage in c.STAGES:
        nothing = stage(spark, nothing, SF)
    assert nothing.count() == 0
