"""Each stage of the pipeline on what its predecessor kept, against brute force."""

import re
import struct

import corpus_pipeline
from public_tokenizers import path as tokenizer
from tokenizers import Tokenizer

from .test_contract import AWKWARD, brute_components, brute_quality, brute_spans, frame, lowered

SF = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        if k < 4:
            assert docs.columns == columns
            kept = {r["doc_id"]: r for r in docs.collect()}
        if name == "quality_rules":
            # too few labels to certify a cutoff: base rules alone
            good = [i for i, t in rows if (q := brute_quality(t))[0] >= 10 and 100 * q[4] <= 20 * q[0]]
            assert sorted(kept) == sorted(good)
        elif name == "near_duplicates":
            assert sorted(kept) == sorted(i for i, _, c, _ in brute_components(rows) if i == c)
        elif name == "benchmark_decontamination":
            words = lambda t: re.findall(WORD, lowered(t))
            items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
            lengths = {len(w) for w in windows}
            clean = [i for i, t in rows if not any(tuple(w[a : a + n]) in windows for w in [words(t)] for n in lengths for a in range(len(w) - n + 1))]
            assert sorted(kept) == sorted(clean) and len(clean) < len(rows)
        elif name == "secret_redaction":
            assert sorted(kept) == sorted(i for i, _ in rows)
            assert not any(brute_spans(r["text"]) for r in kept.values()) and all(r["n_chars"] == len(r["text"]) for r in kept.values())
            assert all(kept[i]["text"] == t for i, t in rows if not brute_spans(t))
        else:
            t, got = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), {}
            for r in docs.orderBy("doc_id", "start").collect():
                got.setdefault(r["doc_id"], []).extend(struct.unpack(f"<{r['length']}I", r["ids"]))
            assert got == {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in rows}


def test_awkward_rows_pass(spark, tmp_path):
    """Awkward rows and clashing columns through all stages: what each keeps is what brute force keeps, by id and text."""
    extra = ("row", "tokens", "out", "key", "sig", "component", "stratum", "cut", "number", "mark")
    text = "long enough to be kept by the rules and quite unlike every other text that stands in this table of awkward rows"
    rows = [*AWKWARD, (100, text), (100, text), (100, text + " id again"), (100, "a second text under one id that has nothing at all in common with the first one"), (None, text + " null"), (None, "no id but words of its own that no other row of all the table shares with it")]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "lang", "'s' as source", "length(text) + 0L as n_chars", *[f"'x' as {c}" for c in extra])
    for case, table in enumerate((docs, docs.where("false"))):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            folder = f"{tmp_path}/{case}-{k}"
            stage(spark, table, SF).write.parquet(folder)
            before, table = [(r["doc_id"], r["text"]) for r in table.collect()], spark.read.parquet(folder)
            if k == 4:
                assert (table.count() > 0) == (case == 0)
                continue
            assert table.columns == list(corpus_pipeline.COLUMNS)
            after = [(r["doc_id"], r["text"]) for r in table.collect()]
            if name == "quality_rules":
                want = [x for x in before if (q := brute_quality(x[1]))[0] >= 10 and 100 * q[4] <= 20 * q[0]]
                assert set(after) <= set(want) and set(want) - set(after) <= {(18, "| " * 40), (19, "!!! " + "WORD!! " * 30)}
            elif name == "near_duplicates":
                assert len(after) == len(set(after)) and set(after) <= set(before)
                kinds = lambda some: {c for _, _, c, _ in brute_components([(n, t) for n, (_, t) in enumerate(some)])}
                assert len(kinds(after)) == len(after) == len(kinds(before))
            else:
                assert len(after) == len(before)
        if case == 0:
            docs = docs.unionByName(docs)
            again = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
            assert again == {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs.limit(10**6), SF).collect()}
