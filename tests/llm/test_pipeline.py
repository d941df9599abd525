"""The pipeline against a brute-force version of its five stages, and on empty and odd tables."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import xxhash
from test_operators import brute_lines, brute_links, brute_statistics

from dimspark.llm import mixing


def brute_mix(rows, seed=7):
    """Documents as often as the mix has them: by targets, in the order of seeded ranks."""
    words = {k: len(t.encode().split()) for k, (_, t, _) in enumerate(rows)}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(words[k] for k, r in enumerate(rows) if r[2] == s) for s in sources]
    targets = mixing.fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(sources))], 1.5 * sum(sizes))
    out = Counter()
    for s, size, target in zip(sources, sizes, targets):
        want = round(target)
        full, rest = divmod(want, size) if size else (0, 0)

        def rank(k):
            i, t, _ = rows[k]
            h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
            h = h if i is None else xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), h)
            return xxhash.xxh64_intdigest(t.encode(), h)

        for k in sorted((k for k, r in enumerate(rows) if r[2] == s), key=rank):
            part = min(words[k], rest)
            rest -= part
            out[k] = full + (words[k] > 0 and 2 * part >= words[k])
    return out


@pytest.fixture(scope="module")
def folder(spark, make_docs, odd_rows, words, tmp_path_factory):
    rng = random.Random(21)
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n))
    rows = list(odd_rows)
    shared = " ".join(rng.choice(words) for _ in range(15))
    for i in range(60):
        body = text(8)
        rows.append((2000 + i, f"{body}\n{shared}" if i % 3 == 0 else body, rng.choice("abc")))
        if i % 10 == 0:
            near = body.split(" ")
            near[20] = "other"
            rows += [(3000 + i, body, "b"), (4000 + i, " ".join(near), "c")]
    where = str(tmp_path_factory.mktemp("tables"))
    make_docs(rows).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(2000, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, rows


def test_run_is_the_five_stages(spark, folder, fresh_ids):
    where, rows = folder
    kept = [r for r in rows if (s := brute_statistics(r[1]))[0] >= 50 and 100 * s[4] <= 50 * s[0]]
    lines = brute_lines(kept)
    texts = defaultdict(list)
    for i, _, _, t in lines:
        texts[i].append(t)
    kept = [(i, texts[i].pop(0), s) for i, _, s in kept]
    _, roots = brute_links(kept)
    least = {}
    for (i, _, _), r in zip(kept, roots):
        least[r] = min(least.get(r, 1 << 60), 1 << 60 if i is None else i)
    kept = [r for r, root in zip(kept, roots) if (1 << 60 if r[0] is None else r[0]) == least[root]]
    mixed = brute_mix(kept)
    want = Counter()
    for k, n in mixed.items():
        if n:
            want[kept[k][0]] += n * (1 + len(fresh_ids(kept[k][1])))
    got = Counter()
    for p in corpus_pipeline.run(spark, where).collect():
        got[p.doc_id] += p.length
    assert got == want and len(got) > 20


def test_a_broken_run_goes_on(spark, folder, tmp_path, monkeypatch):
    """After a stage that failed, the run begins there; what went before is not done again."""
    where, _ = folder
    calls = []

    def counted(name, fn, fails):
        def stage(spark, docs, sf_dir):
            calls.append(name)
            if fails and calls.count(name) == 1:
                raise RuntimeError("an executor too many was lost")
            return fn(spark, docs, sf_dir)

        return name, stage

    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(n, f, n == "line_dedup") for n, f in corpus_pipeline.STAGES])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, where, str(tmp_path / "run"))
    pieces = corpus_pipeline.run(spark, where, str(tmp_path / "run")).count()
    assert pieces and calls == ["quality", "line_dedup", "line_dedup", "near_duplicates", "mixing", "packing"]
    assert sorted(f.name for f in (tmp_path / "run").iterdir()) == ["mixing"]


def test_stages_keep_the_columns_of_documents(spark, folder):
    where, _ = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, where).columns == docs.columns
        assert stage(spark, docs.limit(0), where).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), where).count() == 0


def test_mixing_deals_and_shuffles(spark, make_docs, words, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 50)
    rng = random.Random(22)
    docs = make_docs([(i, " ".join(rng.choice(words) for _ in range(rng.randint(20, 60))), "abc"[i // 200]) for i in range(600)]).coalesce(1)
    corpus_pipeline.mixing(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    where = {}
    for d in mixing.draw_mix(docs).collect():
        where.setdefault(d.doc["doc_id"], {})[d.shard, d.place] = d.doc["source"]
    files = [[r.doc_id for r in spark.read.parquet(str(f)).coalesce(1).collect()] for f in sorted((tmp_path / "mixed").glob("*.parquet"))]
    files = [f for f in files if f]
    assert len(files) >= 30 and sum(map(len, files)) > 700
    last = (-1, -1)
    for ids in files:
        shards = set.intersection(*[{s for s, _ in where[i]} for i in ids])
        assert shards  # all rows of a file are of one shard
        for i in ids:  # and files and rows follow the shuffled order
            last = min(at for at in where[i] if at > last)
        assert last[0] in shards
    beside = [a == b for ids in files for a, b in zip(ids, ids[1:])]
    same = [(a % 600) // 200 == (b % 600) // 200 for ids in files for a, b in zip(ids, ids[1:])]
    assert sum(beside) <= 3 and sum(same) < 0.7 * len(same)
