"""Intermediate tables."""

import os

from relspan.sources.scratch import staged, staged_counted


def test_staged_files_start_one_process_each(spark):
    """No .crc file beside a part: on local file systems Hadoop starts a process for each file that it makes."""
    for out in (staged(spark.range(100), "rows"), staged_counted(spark.range(100), "rows")[0]):
        assert sorted(r.id for r in out.collect()) == list(range(100))
        folder = os.path.dirname(out.inputFiles()[0].removeprefix("file://"))
        assert not [f for f in os.listdir(folder) if f.endswith(".crc")]
