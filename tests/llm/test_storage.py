"""Files that operators leave in the shared folder."""

from pathlib import Path

from sparkquire.llm.common import PLAIN, checkpointed, forget, shared_dir, stored


def test_tables_are_written_without_checksum_files_and_settings_come_back(spark):
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = {key: hadoop.get(key) for key in PLAIN}
    where = Path(shared_dir(spark).removeprefix("file:"))
    old = set(where.rglob("*"))
    table, path = stored(spark.range(100))
    kept = checkpointed(spark.range(100))
    new = [p.name for p in set(where.rglob("*")) - old]
    assert new and not [name for name in new if name.endswith(".crc")]
    assert table.count() == kept.count() == 100
    assert {key: hadoop.get(key) for key in PLAIN} == before
    forget(spark, path)
    assert not Path(path.removeprefix("file:")).exists()
