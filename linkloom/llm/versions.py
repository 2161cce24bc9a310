"""Versions of files with their contents and text fingerprints, as p3, p4 and p5 read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.keys import blank_to_null, clean_hash, effective_algo


def content(algo: Column | str, digest: Column | str) -> Column:
    """A content is (effective algo, lower-case hash), as one string; null without hash."""
    return F.concat(effective_algo(algo), F.lit(":"), clean_hash(digest))


def text_simhash(text_hash: Column | str, simhash: str) -> Column:
    """The fingerprint of a version with text; null where text_hash is empty, whatever the fingerprint says."""
    return F.when(blank_to_null(text_hash).isNotNull(), F.col(simhash))


def index_versions(index: DataFrame) -> DataFrame:
    """(file_ref, content, simhash) of current and previous versions; simhash null without text."""
    named = index.filter(blank_to_null("file_ref").isNotNull())
    now = named.select("file_ref", content("algo", "current_hash").alias("content"), text_simhash("text_hash", "simhash64").alias("simhash"))
    past = named.select("file_ref", F.explode("previous").alias("p"))
    past = past.select("file_ref", content("p.algo", "p.hash").alias("content"), text_simhash("p.text_hash", "p.simhash64").alias("simhash"))
    return now.unionByName(past).filter("content is not null")
