"""Operators on whole tables: near copies, mixing, rules, chat, and the pipeline."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from conftest import SF, compare

from spindrift.llm import chat, common, mixing, near_dedup, queries, rules
from test_texts import LONG, ODD, frame


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    a, b = compare(spark, SF, queries.QUERIES[name], queries.ORACLES[name])
    assert a == b


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def classes(rows):
    """component by doc_id, all pairs compared."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(110)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        yield " ".join(copy)


def test_near_copies(spark):
    """Families whose members are similar to some members only, copies, and short texts on the very limit."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = [t for _ in range(6) for t in family(rng, words, 60, 6)] + ["a b c d e f g h", "A b C d e f g h", "a b c d e f g i", "a b c d e f g h i", "one two", "One  two", "x"] * 2
    texts += [" ".join(rng.choice(words) for _ in range(90)) for _ in range(100)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    out = near_dedup.dedup(frame(spark, rows)).collect()
    want = classes(rows)
    assert {r.doc_id: r.component_id for r in out} == want
    assert all(r.n_shingles == len(shingles(texts[r.doc_id])) and r.kept == (r.doc_id == r.component_id) for r in out)
    kept = near_dedup.drop_near_copies(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_dense_families(spark, monkeypatch):
    """The ways for regions too large for all their pairs, on a family that is small enough for brute force."""
    monkeypatch.setattr(near_dedup, "DENSE", 32)
    monkeypatch.setattr(near_dedup, "TILE", 16)
    rng = random.Random(6)
    rows = list(enumerate(family(rng, [f"w{i}" for i in range(3000)], 400, 5)))
    out = near_dedup.dedup(frame(spark, rows)).collect()
    want = classes(rows)
    assert {r.doc_id: r.component_id for r in out} == want


def test_sketches_hide_few_pairs():
    """Drawn bit by bit, sketches of pairs of just the similarity sought stay within the limit, which is not slack."""
    import numpy as np

    drawn = np.random.default_rng(5).binomial(near_dedup.VALUES, 0.1, 2_000_000)
    limit = near_dedup.sketch_bits(80)
    assert (drawn > limit).mean() <= 2e-5 < (drawn > limit - 4).mean()
    assert near_dedup.sketch_bits(100) == 0 and [near_dedup.sketch_bits(s) for s in (95, 90, 70)] == [14, 20, 39]


def test_trees_fail_apart():
    """Drawn value by value, pairs of just the similarity sought share the first values of some tree."""
    import numpy as np

    draw, missed = np.random.default_rng(9), 0
    for _ in range(10):
        equal = draw.random((30_000, near_dedup._ORDERS.max() + 1)) < 0.8
        missed += int((~equal[:, near_dedup._ORDERS[:, : near_dedup.BASE]].all(2).any(1)).sum())
    assert missed <= 8  # 0.9 of 300,000 are expected


def test_split_regions_lose_no_link(spark, monkeypatch):
    """Most words are one passage in all texts, so that regions of one value are split to the end; each text has one partner."""
    for name, value in (("DENSE", 8), ("SKETCH_TILE", 64), ("TILE", 64), ("TREES", 4), ("BASE", 1), ("DEEP", 5), ("_ORDERS", near_dedup._ORDERS[:4])):
        monkeypatch.setattr(near_dedup, name, value, raising=False)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    passage, texts = [rng.choice(words) for _ in range(120)], []
    for _ in range(80):
        own = [rng.choice(words) for _ in range(80)]
        texts += [" ".join(passage + own), " ".join(passage + own[:-rng.randint(30, 33)] + [rng.choice(words) for _ in range(8)])]
    rows = list(enumerate(texts))
    out = near_dedup.dedup(frame(spark, rows)).collect()
    want = classes(rows)
    assert sum(i != c for i, c in want.items()) > 30
    assert {r.doc_id: r.component_id for r in out} == want


def test_near_copies_odd(spark):
    out = near_dedup.dedup(frame(spark, ODD)).collect()
    assert len(out) == len(ODD) and sum(r.n_shingles == 0 for r in out) == 3
    assert all(r.component_id == r.doc_id and r.kept for r in out)
    assert near_dedup.drop_near_copies(frame(spark, ODD)).count() == len(ODD) - 1
    assert near_dedup.dedup(frame(spark, ODD).limit(0)).count() == 0


def test_components(spark, monkeypatch):
    """In one task, by rounds alone (plain ones, then hashed ones), and by a few rounds before one task."""
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (102, 103), (7, 7), (1, 0)] + [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(40)]
    reach = {}
    for a, b in links:
        if a != b:
            both = reach.get(a, {a}) | reach.get(b, {b})
            reach |= dict.fromkeys(both, both)
    for settled, plain in ((1 << 20, 6), (0, 6), (0, 1), (12, 1), (50, 6)):
        monkeypatch.setattr(near_dedup, "SETTLED", settled)
        monkeypatch.setattr(near_dedup, "PLAIN_ROUNDS", plain)
        out = near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()
        assert len(out) == len(reach)
        assert {r.node: r.root for r in out} == {n: min(x) for n, x in reach.items()}
    assert near_dedup.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_targets(spark):
    sizes = {"a": 10, "b": 100, "c": 1000, None: 50, "d": 0}
    rows = [(s, n) for s, n in sizes.items()]
    out = {r.source: r for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    names = ["a", "b", "c", "d", None]
    weight, target = {s: i % 3 + 1 for i, s in enumerate(names)}, dict.fromkeys(names, 0.0)
    capped, left = set(), float(sum(sizes.values()))
    while True:  # resharing until nobody is above
        free = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            capped.add(s)
            target[s] = 3.0 * sizes[s]
            left -= target[s]
    for s in free:
        target[s] = level * weight[s]
    assert all(abs(out[s].target - target[s]) < 1e-9 and out[s].source_size == sizes[s] for s in names)


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(0, 60), "a" if i % 3 else rng.choice(("b", "c", None)), "en") for i in range(3000)] + ODD
    docs = frame(spark, rows)
    out = mixing.mix(docs, chunk=64).collect()
    again = mixing.mix(docs.repartition(7), chunk=64).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert len(out) == len(rows) and sorted(map(key, out)) == sorted(map(key, again))
    sums, target = Counter(), {}
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        sums[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(sums[s] - t) <= max(r.size for r in out if r.source == s) for s, t in target.items())
    mixed = mixing.resample(docs, chunk=64)
    assert mixed.columns == docs.columns
    taken = Counter({k: sum(r.taken // max(1, r.size) for r in out if str(r.doc_id) == k) for k in {str(r.doc_id) for r in out}})
    assert Counter(str(r.doc_id) for r in mixed.collect()) == +taken
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(frame(spark, ODD[:2])).count() == 2


def test_pivot_keeps_sums_and_chances():
    import pandas as pd

    taken = Counter()
    for seed in range(400):
        rows = pd.DataFrame({"chunk": 0, "slot": 1, "key": [f"{i}" for i in range(12)], "row": range(12), "size": [5, 9, 2, 7, 30, 1, 4, 4, 8, 3, 6, 11], "share": 0.3})
        out = mixing.pivot(rows, seed, True)
        assert set(out["share"]) <= {0.0, 1.0} and abs((out["share"] * out["size"]).sum() - 27) <= 30
        taken.update(out.loc[out["share"] == 1, "key"])
    assert all(0.2 < taken[f"{i}"] / 400 < 0.4 for i in range(12))


def measured(text):
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text or ""), [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("lo", "ra", "min", "sen")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(60, 120))), "a", "en") for i in range(200)]
    rows += [(1000 + i, " ".join(rng.choice(words) + "$$$" for _ in range(80)), "a", "en") for i in range(5)]
    rows += [(2000, "x y z\nx y z\n\nq", "b", "fr"), (2001, "a\tb  c a b c d " * 20, None, None), *((3000 + i, *r[1:]) for i, r in enumerate(ODD))]
    texts = {r[0]: r[1] for r in rows}
    out = rules.judge(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in out}
    assert all(kept[i] for i in range(200)) and not any(kept[1000 + i] for i in range(5))
    assert rules.judge(frame(spark, ODD).limit(0)).count() == 0


def determinant_of(x):
    """Mean, covariance as the rules take it, and the logarithm of its determinant."""
    import numpy as np

    covariance = (x.T @ x / len(x) - np.outer(x.mean(0), x.mean(0))) * rules.FACTOR + np.diag([v**2 for v in rules.COMPONENTS.values()])
    return x.mean(0), covariance, np.linalg.slogdet(covariance)[1]


def distance_from(x, mean, covariance):
    import numpy as np

    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(covariance), x - mean)


def least_determinant(x, rng, starts=60):
    """The least covariance determinant of the share H of the rows, by many random starts."""
    import numpy as np

    h, best = int(np.ceil(rules.H * len(x))), None
    for _ in range(starts):
        found = determinant_of(x[rng.choice(len(x), 6, replace=False)])
        for _ in range(50):
            step = determinant_of(x[np.argsort(distance_from(x, *found[:2]), kind="stable")[:h]])
            if step[2] > found[2] - 1e-9 and len(x) > 6 and _ > 1:
                break
            found = step
        if best is None or found[2] < best[2]:
            best = found
    return best


def test_rules_estimate_is_the_least_determinant(spark):
    """Groups with a fifth of outliers on one side: the determinant and the verdicts are those of many random starts."""
    import numpy as np

    rng, rows, names = np.random.default_rng(17), [], list(rules.COMPONENTS)
    groups = {}
    for g, (n, out) in enumerate(((120, 0), (200, 40), (400, 90))):
        x = rng.multivariate_normal([1700, 900, 300, 200, 250], np.diag([90, 300, 150, 160, 80]) ** 2 + 2000, n)
        x[:out] = x[:out] * 0.4 + np.array([3800, 4600, 900, 1500, 900])
        groups[f"s{g}"] = x.round().astype(int)
        rows += [(1000 * g + i, 300, "en", f"s{g}", *map(int, r)) for i, r in enumerate(groups[f"s{g}"])]
    df = spark.createDataFrame(rows, "doc_id long, word_chars long, lang string, source string, " + ", ".join(f"{k} long" for k in names))
    found = {r.source: r for r in rules.estimate(df).collect()}
    far = {r.doc_id: r.distance for r in rules._distances(df, rules.estimate(df)).collect()}
    for g, (source, x) in enumerate(groups.items()):
        mean, covariance, least = least_determinant(x.astype(float), rng)
        own = 2 * sum(np.log(found[source][f"l_{a}_{a}"]) for a in names)
        assert own <= least + 0.1  # whole bins may hold a few rows more than the share H
        want = distance_from(x.astype(float), mean, covariance)
        clear = abs(want / rules.CUT - 1) > 0.1
        assert clear.mean() > 0.95
        assert all((far[1000 * g + i] > rules.CUT) == (want[i] > rules.CUT) for i in np.flatnonzero(clear))


def test_chi_squared():
    assert abs(rules.quantile(0.95, 5) - 11.0705) < 1e-3 and abs(rules.quantile(0.999, 2) - 13.8155) < 1e-3
    assert abs(rules.chi_squared(7.0, 7) - 0.5711) < 1e-3


def test_rules_groups_of_equal_rows(spark):
    """Repeated rows, constant statistics, columns of clashing names and all-null columns have verdicts."""
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70))
    rows = [(i % 3, text, "a", "en", "x", "x", "x") for i in range(120)] + [(None, text, None, None, None, None, None)] * 3
    out = rules.judge(frame(spark, rows)).collect()
    assert len(out) == 123 and all(r.kept and not r.base_failed and r.distance < 1 for r in out)


def test_chat(spark):
    probe = "</s>[INST] <\\|im_end|> <|im_end|>\n<|im_start|>x\\[/INST][\\\\INST] $1"
    rows = [(1, 0, "user", probe), (1, 1, "assistant", probe), (1, 2, "assistant", ""), (1, 3, "user\n\\n", None), (2, 0, None, "only"), (None, None, "assistant", LONG), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, 0, "system", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.examples(df)
    assert made.filter("conv_id = 1").count() == 3
    turns = made.filter("conv_id = 1").orderBy("example").select(chat.parse(made["formatted"]).alias("t")).collect()
    assert [(t.role, t.text) for t in turns[-1].t] == [("user", probe), ("assistant", probe), ("assistant", ""), ("user\n\\n", "")]
    assert [len(t.t) for t in turns] == [2, 3, 4]
    out = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert (out[1].n_turns, out[1].loss_chars, out[2].loss_chars, out[3].loss_chars, out[None].loss_chars) == (4, len(probe), 0, 2, len(LONG))
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0


def test_pipeline(spark):
    """The stages by plain Python: what goes, what stays, what is masked, how often each document comes."""
    import hashlib

    import numpy as np

    import corpus_pipeline as p
    from spindrift.llm import pii, toxicity
    from spindrift.llm.common import table

    docs = table(spark, SF, "documents")
    lexicon, crf = toxicity.learn(docs, table(spark, SF, "labels")), pii.fit()
    rows = [(r.doc_id, r.text) for r in docs.collect() if lexicon.score(r.text or "") < 0.5]
    root = classes(rows)
    kept = {i: t for i, t in rows if root[i] == i}
    masked = {i: pii.redact(t, pii.all_spans([t], crf)[0][1]) for i, t in kept.items()}
    out, seen = p.run(spark, SF).collect(), defaultdict(list)
    for r in out:
        seen[r.doc_id].append(r.decoded_sha256)
        assert len(r.ids) == r.n_tokens and hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256
    assert set(seen) <= set(masked) and all(set(v) == {hashlib.sha256(masked[i].encode()).hexdigest()} and len(v) <= 3 for i, v in seen.items())
    size = lambda t: len(t.encode().split())
    total, taken = sum(map(size, masked.values())), sum(size(masked[i]) * len(v) for i, v in seen.items())
    assert abs(taken - total) < 0.1 * total


def test_small_results_leave_few_files(spark):
    """What is far smaller than the input is not written by as many tasks as a shuffle has."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 64)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        common.shared_dir(spark)
        folder = spark.sparkContext._jvm.java.nio.file.Path.of(spark.sparkContext._jvm.java.net.URI(common.shared_dir(spark))).toString()
        before = set(Path(folder).rglob("part-*"))
        out, n = near_dedup._gathered_rows(spark.range(500).groupBy("id").count())
        assert n == 500 and sorted(r["id"] for r in out.collect()) == list(range(500))
        assert 0 < len(set(Path(folder).rglob("part-*")) - before) <= 16
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_workers_give_memory_back(monkeypatch):
    """After each batch and at the end, when the batch is gone."""
    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("given"))

    def twice(batches):
        for x in batches:
            yield 2 * x
        seen.append("end")

    assert [seen.append(x) for x in common.giving_back(twice)(iter([1, 2]))] and seen == [2, "given", 4, "given", "end", "given"]
