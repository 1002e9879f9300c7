"""The driver contract, and queries beside their SQL on the smallest tables."""

import importlib
import os
import sys

import pytest

import __spark_entry__ as entry_module
from checks import ORACLES, QUERIES
from checks.compare import compare, connect

from .conftest import SF

QUICK = (
    "clean_text_html mask_emails symbol_tokens sentence_lengths style_features style_slice emotion_signals lexicon_emotion "
    "oov_rate pos_counts dep_depth url_domain parse_date hash_embed context_flags pool_attention merge_last_wins "
    "merge_last_wins_drop presence_flags safe_numeric label_distribution guess_label_columns read_splits export_csv"
).split()
NAMES = list(entry_module.oracle_sql()) if os.environ.get("ROTATIVA_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_training_data_queries_may_be_missing(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    without = importlib.import_module("__spark_entry__")
    assert set(without.queries()) == set(QUERIES) and set(without.oracle_sql()) == set(ORACLES)


def test_flagship(spark):
    df = entry_module.entry(spark)
    assert len(df.columns) == 36 and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF, entry_module.queries()[name], entry_module.oracle_sql()[name])
    assert ok, message
    assert "types differ" not in message
