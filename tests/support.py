"""What the tests share besides fixtures. Tests import it by this name, never from a conftest."""

import os

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def values(df, column):
    return [r[column] for r in df.collect()]
