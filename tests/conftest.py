import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").appName("weft-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        # tests only: the cluster names its shared folder in spark.checkpoint.dir
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s


@pytest.fixture(scope="session")
def patients(spark):
    """The reference's 50-row patients fixture shape (values are our own)."""
    import datetime as dt

    rows = []
    for i in range(50):
        adm = dt.datetime(2023, 1, 1) + dt.timedelta(days=3 * i)
        rows.append((f"p{i:04d}", f"Patient{i}", f"Surname{i}", 18 + (i * 7) % 72, ["Male", "Female", "Other"][i % 3],
                     ["A+", "B+", "O+", "AB-"][i % 4], adm, adm + dt.timedelta(days=4), f"Diagnosis_{i % 10}",
                     ["Cardiology", "Oncology", "Neurology"][i % 3], f"DR{i:04d}", 1000.0 + 37.5 * i,
                     None if i % 5 == 0 else ["Star", "Care"][i % 2], ["Mumbai", "Pune", "Delhi"][i % 3],
                     dt.datetime(2023, 1, 1) + dt.timedelta(days=i)))
    schema = ("patient_id string, first_name string, last_name string, age long, gender string, blood_type string, "
              "admission_date timestamp, discharge_date timestamp, diagnosis string, department string, "
              "doctor_id string, bill_amount double, insurance_provider string, city string, created_at timestamp")
    return spark.createDataFrame(rows, schema)
