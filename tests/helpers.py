"""Helpers the test modules import by name; kept out of ``conftest`` so no other conftest can shadow them."""

from __future__ import annotations

import os

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def as_set(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found)), "duplicate rows"
    return set(found)


def as_list(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
