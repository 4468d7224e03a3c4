from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
# Tasks that run Python look for the package on this path.
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

from boxmetrics.session import build_session  # noqa: E402
from boxmetrics.schemas import TRANSFORM_SCHEMAS  # noqa: E402
from boxmetrics.sources.csv_files import read_staging  # noqa: E402
from boxmetrics.sources.layers import load_files, save_files  # noqa: E402
from boxmetrics.tables import Tables  # noqa: E402
from boxmetrics.transforms import build_transform  # noqa: E402
from tests import seed_rows  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("spark")
    session = build_session(
        "local[4]",
        4,
        **{
            "spark.sql.warehouse.dir": str(scratch / "warehouse"),
            "spark.checkpoint.dir": str(scratch / "shared"),
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def seed_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("seeds")
    for name, text in seed_rows.FILES.items():
        bom = "﻿" if name in seed_rows.WITH_BOM else ""
        (folder / f"{name}.csv").write_text(bom + text, encoding="utf-8")
    return str(folder)


@pytest.fixture(scope="session")
def seed_staging(spark, seed_folder):
    return read_staging(spark, seed_folder)


@pytest.fixture(scope="session")
def seed_tables(spark, seed_staging, tmp_path_factory):
    """Cleaned sample tables, read back from files as a report would."""
    folder = str(tmp_path_factory.mktemp("transform"))
    save_files(build_transform(seed_staging).frames(), folder)
    return Tables.from_frames(load_files(spark, TRANSFORM_SCHEMAS, folder))
