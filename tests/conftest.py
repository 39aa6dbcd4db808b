from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tabscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def capture() -> pd.DataFrame:
    """520 flow rows from plain arithmetic and nine of them again; some header names have blanks around them."""
    i = np.arange(520)
    table = pd.DataFrame({" Sensor": 100 + i * 17 % 263, "Idle": 1.5 * (1 + i * 37 % 211)})
    table["Bytes Out"] = 10.0 + i * i % 97
    table[" Bytes In "] = (i * 53 % 71).astype(float)
    table["Twin"] = table["Bytes Out"] + np.sin(i) / 200
    table["Size"] = 1.25 * (i * 29 % 1009)
    table["Flags"] = 0.0
    table[" Mode"] = np.where((i == 100) | (i == 400), 90.0, 3.0)
    table["Ratio/s"] = table["Bytes Out"] / table["Idle"]
    table.loc[i % 40 == 7, ["Idle", "Ratio/s"]] = 0.0, np.inf
    table.loc[i % 65 == 3, " Bytes In "] = np.nan
    table.loc[i % 26 == 5, "Size"] = np.nan
    table[" Label"] = np.select([i % 20 == 0, i % 7 == 0], ["scan", "flood"], "normal")
    return pd.concat([table, table.tail(9)], ignore_index=True)


@pytest.fixture(scope="session")
def capture_csv(capture, tmp_path_factory) -> str:
    path = tmp_path_factory.mktemp("raw") / "Wednesday-workingHours.pcap_ISCX.csv"
    capture.to_csv(path, index=False)
    return str(path)


@pytest.fixture(scope="session")
def flow_table(spark, capture_csv):
    from tabscope.session import stage_table
    from tabscope.sources.csv_tables import load_csv

    return stage_table(load_csv(spark, capture_csv), "flows")


@pytest.fixture(scope="session")
def small_profile(flow_table):
    from tabscope.plans.profile import build_profile

    return build_profile(flow_table)
