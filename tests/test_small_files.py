"""Many small statement files: how folders are listed, and what is written beside each file."""

import glob

from munim.plans.catalog import QUERIES
from munim.sources import files as L


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    for n in range(200):
        (tmp_path / f"statement_id={n}").mkdir()
        (tmp_path / f"statement_id={n}/a.csv").write_text(f"Date,Amount\n01-01-2025,{n}\n")
    context = spark.sparkContext
    for k, read in enumerate((L.raw_lines, L.list_files)):
        context.setJobGroup(f"listing-{k}", "listing")
        try:
            rows = read(spark, str(tmp_path))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        track = context.statusTracker()
        tasks = [track.getStageInfo(s).numTasks for j in track.getJobIdsForGroup(f"listing-{k}")
                 for s in track.getJobInfo(j).stageIds]
        assert tasks and max(tasks) <= 4 * context.defaultParallelism < 200
        assert rows.count() == (400, 200)[k]
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


def test_no_checksums_beside_written_statements(spark):
    QUERIES["load_files"](spark, "/root/testdata/sf0.001")
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    folders = glob.glob(f"{top}/files-*")
    assert folders and glob.glob(f"{folders[-1]}/statement_id=*/*.txt")
    assert all(not glob.glob(f"{f}/statement_id=*/.*.crc") for f in folders)
