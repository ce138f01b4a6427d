import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from lapse.session import ensure_checkpoint_dir
    s = (SparkSession.builder.master("local[4]").appName("lapse-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.driver.memory", "6g")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


RAW_COLS = ["customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
            "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
            "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod", "MonthlyCharges",
            "TotalCharges", "Churn"]


def raw_row(cid, tenure=10, monthly=50.0, total="500.0", churn="No", contract="Month-to-month",
            internet="DSL", payment="Electronic check", senior=0, security="No", tech="No"):
    return (cid, "Female", senior, "Yes", "No", tenure, "Yes", "No", internet, security, "No", "No", tech, "Yes",
            "No", contract, "Yes", payment, monthly, total, churn)


@pytest.fixture()
def raw_df(spark):
    def make(rows):
        from lapse.config import RAW_SCHEMA
        return spark.createDataFrame(rows, RAW_SCHEMA)
    return make
