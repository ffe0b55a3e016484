"""Small ranges cost what they hold: no more is read for one, and a task may read many."""

import io

from sessionlake.sources import log_lines


class Counted(io.BytesIO):
    got = 0

    def read(self, n=-1):
        out = super().read(n)
        self.got += len(out)
        return out


def test_a_short_range_reads_little():
    data = b"\n".join(b"x" * (k % 90) for k in range(40_000))
    stream = Counted(data)
    lines = list(log_lines.lines_of(stream, 500_000, 510_000))
    assert lines and stream.got < 100_000
    assert b"\n".join(lines) in data


def test_a_task_reads_many_ranges(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"f{f}.jsonl").write_text("\n".join(f"{f} {k}" for k in range(3_000)))
    spark.dataSource.register(log_lines.LogLines)
    load = lambda **o: spark.read.format("log_lines").option("path", str(tmp_path)).options(**o).load()
    one, many = load(split_bytes="500"), load(split_bytes="500", task_bytes="20000")
    assert many.rdd.getNumPartitions() < one.rdd.getNumPartitions() / 20
    key = lambda rows: sorted((r["path"], r["range"], r["place"], r["line"]) for r in rows.collect())
    assert key(many) == key(load(split_bytes="500", task_bytes="100000000"))
    got = log_lines.read(spark, str(tmp_path), split_bytes=500, task_bytes=20_000).collect()
    assert sorted((r["line"].split()[0], r["line_no"]) for r in got if r["line"]) == sorted((str(f), k) for f in range(3) for k in range(3_000))
