"""Queries are lazy plans over the given files: nothing is written or run while they are built."""

import os

import pytest

import retainr.session as session
from retainr.plans import churn
from retainr.plans.registry import QUERIES
from retainr.sources.mapping import canonical_tables
from tests.conftest import SF_SMALL

# one-hot columns are named after the values in the data, so these must be read first
READS_FIRST = {"modeling_dataset"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_building_runs_no_job_and_reads_given_files_only(spark, name):
    sc = spark.sparkContext
    sc.setJobGroup(f"build-{name}", name)
    try:
        df = QUERIES[name](canonical_tables(spark, SF_SMALL))
        jobs = [j for j in sc.statusTracker().getJobIdsForGroup(f"build-{name}")]
    finally:
        sc.setJobGroup("tests", "tests")
    # resolving a Parquet file reads its footer in a job of one task
    tasks = sum(s.numTasks for j in jobs for i in (sc.statusTracker().getJobInfo(j).stageIds if sc.statusTracker().getJobInfo(j) else [])
                if (s := sc.statusTracker().getStageInfo(i)))
    assert name in READS_FIRST or tasks == len(jobs) <= 8
    assert all(SF_SMALL in f for f in df.inputFiles()), df.inputFiles()


def test_no_local_folder_is_made(spark, monkeypatch, tmp_path):
    monkeypatch.setenv("TMPDIR", str(tmp_path))
    QUERIES["rfm_user_ltv"](canonical_tables(spark, SF_SMALL)).count()
    assert not [f for f in os.listdir(tmp_path) if "retainr" in f]


def test_minmax_scores(spark):
    df = spark.createDataFrame([(1, -2.0), (2, 0.0), (3, 6.0)], "user_id long, raw double")
    got = [r[0] for r in churn.minmax_scores(df, "raw").orderBy("user_id").select("churn_proba").collect()]
    assert got == [0.0, 0.25, 1.0]


def test_cluster_sizing():
    conf = session.cluster_conf(100 * 2**40, executors=1000, cores_per_executor=4,
                                executor_memory_gb=16)
    assert int(conf["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 * 2**20)
    assert int(conf["spark.sql.files.maxPartitionBytes"]) == 256 * 2**20
    small = session.cluster_conf(10 * 2**30, executors=10, cores_per_executor=8, executor_memory_gb=8)
    assert int(small["spark.sql.shuffle.partitions"]) >= 160
    assert int(small["spark.sql.adaptive.advisoryPartitionSizeInBytes"]) == 256 * 2**20
