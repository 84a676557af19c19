"""One row of some 20 MB between short ones, through each operator on documents and on conversations."""

import random
import string

import pytest
from pyspark.sql import functions as F

from tessella.llm import chat_format, lattice, packing, quality, setsketch, suffix_lm, token_files
from tessella.llm.queries import vocabulary

WORDS = 3_000_000


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(3)
    words = [f"{a}{b}{rng.randrange(100)}" for a in string.ascii_letters for b in "aeiou"]
    lines = [" ".join(rng.choices(words, k=20)) for _ in range(WORDS // 20)]
    return "\n".join(lines) + "\n" + "x" * 5_000_000


@pytest.fixture(scope="module")
def docs(spark, long_text):
    rows = spark.createDataFrame([(1, "short one"), (3, None)], "doc_id long, text string")
    whole = spark.createDataFrame([(2,)], "doc_id long").withColumn("text", F.lit(long_text))
    return rows.unionByName(whole).withColumn("source", F.lit("s")).coalesce(1)


def test_packing_and_token_files(docs, long_text):
    packed = packing.pack_documents(docs, vocabulary()).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    files = {r.doc_id: r.n_tokens for r in token_files.token_files(docs, vocabulary()).collect()}
    assert {r.doc_id: r.n for r in packed} == files and files[2] > WORDS


def test_quality_rules(docs):
    got = {r.doc_id: (r.n_words, r.n_dup_lines, r.kept) for r in quality.quality_rules(docs).collect()}
    assert got[2] == (WORDS + 1, 0, True) and got[1][0] == 2 and got[3][0] == 0


def test_lattice(docs):
    got = {r.doc_id: r.n_tokens for r in lattice.encode_documents(docs.select("doc_id", "text"), vocabulary("piece_bpe_32k.model")).collect()}
    assert got[2] > WORDS and got[3] == 0


def test_scores(docs):
    got = {r.doc_id: r.n_tokens for r in suffix_lm.score_documents(docs).collect()}
    assert got == {1: 3, 2: WORDS + 2, 3: 1}


def test_near_duplicates(docs):
    twice = docs.unionByName(docs.filter("doc_id = 2").withColumn("doc_id", F.lit(4).cast("long")))
    got = {r.doc_id: (r.component_id, r.n_shingles > 50_000) for r in setsketch.near_duplicates(twice, size=2).collect()}
    assert got == {1: (1, False), 2: (2, True), 3: (3, False), 4: (2, True)}


def test_conversations(spark, long_text):
    rows = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant")], "conv_id long, turn long, role string").withColumn("text", F.lit(long_text))
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.conversation_digests(rows).collect()}
    assert got[1] == (2, len(long_text)) and set(got) == {1, -7}
