import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fairtag.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("fairtag-tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def gpu(spark):
    """The card catalog, its products read once."""
    from dataclasses import replace

    from fairtag.sources.gpu import gpu_catalog

    catalog = gpu_catalog(spark)
    products = spark.createDataFrame(catalog.products.collect(), catalog.products.schema)
    return replace(catalog, products=products)
