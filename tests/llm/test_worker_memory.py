"""What Python workers hold: numbers of words in four bytes, caches with bounds, and few large rows at once."""

import numpy as np

from sessionlake import session
from sessionlake.llm import op02_bpe, op11_collocations


def test_paths_are_merged_in_four_bytes_and_given_up():
    columns = [np.array(c, np.int32) for c in ([2, 1, 2, 1], [1, 3, 1, 0], [0, 2, 0, 0], [0, 1, 0, 0])]
    paths = op11_collocations.Paths.merged(columns, None, 4)
    assert not columns and {c.dtype for c in paths.columns} == {np.dtype(np.int32)}
    assert list(zip(*(c.tolist() for c in paths.columns), strict=True)) == [(1, 0, 0, 0), (1, 3, 2, 1), (2, 1, 0, 0)] and paths.counts.tolist() == [1, 1, 2]
    again = op11_collocations.Paths.merged([np.concatenate([c, c]) for c in paths.columns], np.concatenate([paths.counts, paths.counts]), 4)
    assert again.counts.tolist() == [2, 2, 4]


def test_rows_at_once_hold_for_one_frame(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    session.ensure_checkpoint_dir(spark)
    before = spark.conf.get(key)
    sizes = spark.range(1000, numPartitions=1).mapInArrow(lambda batches: (b for b in batches), "id long")
    seen = session.settled(sizes.mapInPandas(lambda frames: (f.head(1).assign(id=len(f)) for f in frames), "id long"), 64)
    assert max(r["id"] for r in seen.collect()) <= 64 and spark.conf.get(key) == before


def test_caches_of_an_encoder_are_bounded():
    from corpus_pipeline import vocabulary_path

    wide, small = op02_bpe.PrefixEncoder(vocabulary_path()), op02_bpe.PrefixEncoder(vocabulary_path(), cached_words=10, known_fits=20)
    for k in range(200):
        text = f"word{k * 7919} other{k % 13}, a-b{k}"
        assert small.encode(text) == wide.encode(text)
    assert max(map(len, (small.cache, small.older, small.word_cache))) <= 10 and len(small.fits) <= 20
    assert wide.cached_words <= 100_000 and wide.known_fits <= 200_000
