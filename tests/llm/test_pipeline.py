"""Each stage of the corpus pipeline against a plain restatement, and on awkward and empty tables."""

import zlib
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_jaccard import kept, planted
from voltline.llm import bpe, common, packing, quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Labelled documents that the classifier can learn from, with copies and a shared passage."""
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = planted(9)[:220]
    passage = " ".join(f"q{i}" for i in range(50))
    rows += [(1000 + i, "%%% $$$ " * (3 + i)) for i in range(60)]
    rows += [(2000 + i, f"{i} {passage} end{i} {' '.join(f'u{i}x{j}' for j in range(80))}") for i in range(4)]
    rows += [(3000, rows[5][1].replace(" ", "  ")), (3001, None), (3002, ""), (3003, rows[6][1])]
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if 1000 <= i < 2000 else 1, 0) for i, _ in rows if i < 3000]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows_of(df):
    return sorted((r.doc_id, r.text or "") for r in df.collect())


def plain_passages(rows, window=35):
    words = {i: t.split() for i, t in rows}
    seen = Counter(tuple(w[p : p + window]) for w in words.values() for p in range(len(w) - window + 1))
    out = []
    for i, t in rows:
        w, gone = words[i], set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        out.append((i, " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t))
    return sorted(out)


def test_stages_equal_plain_restatements(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    stage = dict(pipeline.STAGES)

    good = stage["quality classifier"](spark, docs, sf_dir)
    assert good.columns == docs.columns
    model = quality.fitted(spark, sf_dir)
    wanted = [(i, t) for i, t in rows_of(docs) if model.score(t) >= quality.THRESHOLD]
    assert rows_of(good) == wanted and 0 < len(wanted) < docs.count()

    single = stage["exact dedup"](spark, good, sf_dir)
    best = {}
    for i, t in wanted:
        k = "".join(t.split())
        best[k] = min(best.get(k, (0, 1 << 62, "")), (-len(t), i, t))
    single_rows = sorted((i, t) for _, i, t in best.values())
    assert single.columns == docs.columns and rows_of(single) == single_rows

    near = stage["simhash near-dedup"](spark, single, sf_dir)
    left = set(kept(single_rows))
    near_rows = [(i, t) for i, t in single_rows if i in left]
    assert near.columns == docs.columns and rows_of(near) == near_rows

    cut = stage["substring dedup"](spark, near, sf_dir)
    assert cut.columns == docs.columns and rows_of(cut) == plain_passages(near_rows)
    assert all(r.n_chars == len(r.text or "") for r in cut.collect())

    pieces = stage["packing"](spark, cut, sf_dir).collect()
    encoder = packing.library_encoder(open(bpe.default_vocabulary(), "rb").read())
    for i, t in plain_passages(near_rows):
        ids = next(encoder.encode_batch([t])) + (1).to_bytes(4, "little")
        mine = sorted((r.start, r.length, r.ids_crc32) for r in pieces if r.doc_id == i)
        assert sum(n for _, n, _ in mine) == len(ids) // 4
        assert all(c == zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n, c in mine)


def test_run_equals_its_stages(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    for name, stage in pipeline.STAGES:
        docs, _ = common.written(stage(spark, docs, sf_dir), "t")
    key = lambda df: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    tokens = lambda df: Counter({r.doc_id: r.doc_tokens for r in df.collect()})
    assert tokens(pipeline.run(spark, sf_dir)) == tokens(docs) and sum(key(docs).values()) == docs.count()


@pytest.mark.parametrize("empty", [True, False])
def test_stages_take_awkward_tables(spark, sf_dir, empty):
    rows = [] if empty else [(None, "null id"), (None, None), (1, None), (1, None), (2, ""), (3, " \t"), (4, "y" * 100_000), (5, "one two"), (5, "one  two")]
    df = frame(spark, rows)
    for name, stage in pipeline.STAGES[1:]:
        out = stage(spark, df, sf_dir)
        texts = Counter((r.doc_id, r.text) for r in out.collect()) if name != "packing" else None
        if empty:
            assert out.count() == 0
        elif name == "exact dedup":
            assert texts == Counter({(None, "null id"): 1, (3, " \t"): 1, (4, "y" * 100_000): 1, (5, "one  two"): 1})
        elif name == "packing":
            assert out.where("start = 0").count() == len(rows)
        elif name == "substring dedup":
            assert texts == Counter(rows)
