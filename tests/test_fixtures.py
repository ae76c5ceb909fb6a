"""The derived tables on texts and sizes that the small tables lack."""

from __future__ import annotations

import os
import shutil

import duckdb
import pytest

from readloom.plans import catalog, fixtures
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """sf0.001 with characters in the contigs whose upper case has several letters, or is a letter of A-Z."""
    home = str(tmp_path_factory.mktemp("odd"))
    for f in os.listdir(SF):
        shutil.copy(f"{SF}/{f}", home)
    os.chmod(f"{home}/documents.parquet", 0o644)
    os.remove(f"{home}/documents.parquet")
    duckdb.execute(f"copy (select * replace (replace(text, 'e', 'e\u00df\ufb01\u0149\u0131\u017f\u00e9') as text) from '{SF}/documents.parquet') to '{home}/documents.parquet' (format parquet)")
    return home


def test_contigs_have_the_letters_of_the_sql(spark, odd):
    want = oracle.duck_rows(oracle.duck(odd), fixtures.sql("select * from ref", "ref"))
    assert oracle.spark_rows(fixtures.ref(spark, odd)) == want


@pytest.mark.parametrize("name", ["aligned_bases", "aln_end", "bam_region_pushed", "base_counts", "bin_table", "capped_and_printed", "coverage", "crai_find", "crai_find_order"])
def test_queries_follow_such_contigs(spark, odd, name):
    assert oracle.spark_rows(catalog.QUERIES[name](spark, odd)) == oracle.duck_rows(oracle.duck(odd), catalog.SQL[name])


@pytest.mark.parametrize("name", ["bai_round_trip", "bam_written_and_read", "bits_per_base", "cg_split_pack", "crai_build"])
def test_files_and_packs_of_reads_follow_such_contigs(spark, odd, name):
    assert oracle.spark_rows(catalog.QUERIES[name](spark, odd)) == oracle.duck_rows(oracle.duck(odd), catalog.SQL[name])
