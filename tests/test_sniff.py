"""The format of a file is told from its first bytes."""

import gzip

import pytest

from evigraph.sources import tabular


@pytest.mark.parametrize("raw, kind", [(b"PK\x03\x04", "xlsx"), (b"PAR1", "parquet"), (gzip.compress(b"a,b"), "gzip"), (b' {"a": 1}', "json"), (b"a\tb\tc,d\n1,2,3,4", "tsv"), (b"a,b\n", "csv"), (b"", "csv"), (b"x" * 9000, "csv")])
def test_formats(spark, tmp_path, raw, kind):
    (tmp_path / "f").write_bytes(raw)
    assert tabular.sniff(spark, str(tmp_path / "f")) == kind


def test_folders(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tabular.sniff(spark, str(tmp_path))
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert tabular.sniff(spark, str(tmp_path / "t")) == "parquet" and tabular.read_flexible(spark, str(tmp_path / "t")).count() == 3
