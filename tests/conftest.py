import pytest
from pyspark.sql import SparkSession

from prismetric.session import SETTINGS


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").config(map=SETTINGS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    session = builder.config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture
def people(tmp_path):
    path = tmp_path / "people.csv"
    path.write_text(
        "id,full_name,email,phone,ssn,dob,ip_address,note\n"
        "1,Ann Lee,ann@example.com,+1 555 123 4567,123-45-6789,1990-01-02,10.0.0.1,hello\n"
        "2,Bob Ray,bob@example.org,555-987-6543,219-09-9999,1985-07-30,192.168.1.77,\n"
        "3,Cy Fox,cy@example.net,555-222-3333,321-12-1234,1979-11-11,172.16.4.5,fine\n"
    )
    return path
