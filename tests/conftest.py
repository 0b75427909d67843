import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

# the 19-sample genotype / phenotype sample files (tab-separated, sample-major)
# behind the golden objectives; point these at them to run those tests
SAMPLE_GENO = os.environ.get("SPARSELM_SAMPLE_GENO", "")
SAMPLE_PHENO = os.environ.get("SPARSELM_SAMPLE_PHENO", "")
TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "4g")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    # tests own their checkpoint folder (a cluster names a shared one)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparselm-test-ckpt-"))
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="sparselm-test-")


def write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path
