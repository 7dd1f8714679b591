"""Archives of documents with a hash-chained ledger: manifests sealed, linked, and verified over ranges of lines.

A manifest names an archive's files with their SHA-256; a ledger line holds the manifest's hash and the hash of the line before, so that
a changed, deleted, inserted or moved line shows. Hashes are those of canonical JSON: sorted keys, no spaces, text as it is.

Linking is sequential by definition (each hash needs the one before): one task per chain, which holds one hash; a chain of over MOST_LINKED lines is
linked range after range, so that no task sorts all of it. Verifying is not: lines are checked
in ranges, and the last line of a range is carried to the next, so one chain of any length is checked by many tasks.

Cases: a line that is no JSON object or has no entry_hash is unreadable, and the line after it has no link to hold; null lines are
unreadable; keys beyond the known ones count in a line's hash; of several lines for one archive the last holds; null archive ids
match nothing; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, folder
from . import prefix

GENESIS = "0" * 64
FILE = "array<struct<role: string, filename: string, sha256: string, size: bigint, content_type: string>>"
CORE = ("archive_id", "archived_at", "files", "invoice_number", "operation", "owner_id")
#: what verification says (fixed values; {} is a line's number or a file's name)
UNREADABLE, MODIFIED = "Ledger line {} is unreadable", "Ledger entry {} was modified"
BROKEN = "Ledger chain is broken at entry {} (entry deleted, inserted or reordered)"
MISSING, MISMATCH = "File missing: {}", "Hash mismatch (file modified): {}"
CHANGED, NO_ENTRY = "Manifest content does not match its recorded hash", "No ledger entry found for this archive"
DIFFERS, DELETED = "Manifest does not match the ledger entry", "Archive directory or manifest was deleted"


def canonical(document: Column, without: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> Column:
    """A JSON object (variant) with sorted keys and no spaces, without or with only some of its own keys; null if it is no object."""
    keep = lambda k: (k.isin(*only) if only else F.lit(True)) & (~k.isin(*without) if without else F.lit(True))
    entries = F.array_sort(F.map_keys(document))
    # values keep the order of their own keys: variants sort them
    pair = lambda k: F.concat(F.to_json(k.cast("variant")), F.lit(":"), F.to_json(document[k]))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.filter(entries, keep), pair), ","), F.lit("}"))


def _object(text: Column) -> Column:
    """The text's JSON object by key; null for anything else."""
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed).cast("map<string, variant>")


def _string(document: Column, key: str) -> Column:
    return F.try_variant_get(document[key], "$", "string")


def stored_name(index: Column, role: Column, filename: Column) -> Column:
    """Number, role and the file's own name in safe characters."""
    base = F.regexp_extract(F.coalesce(F.nullif(filename, F.lit("")), F.lit("file")), "[^/]*$", 0)
    safe = F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]", "_"), "^[._]+|[._]+$", "")
    safe = F.substring(F.when(safe == "", "file").otherwise(safe), 1, 120)
    return F.concat(F.lpad(index.cast("string"), 2, "0"), F.lit("_"), role, F.lit("__"), safe)


def sealed(archives: DataFrame) -> DataFrame:
    """archives with `stored` (the files' entries), `core` (the manifest's canonical text) and manifest_sha256.

    archives: archive_id, archived_at (text), operation, invoice_number, owner_id, files (array of role, filename, content, content_type).
    """
    of_file = lambda f, i: F.struct(
        f["content_type"].alias("content_type"), stored_name(i, f["role"], f["filename"]).alias("filename"), f["role"].alias("role"), F.sha2(f["content"], 256).alias("sha256"), F.length(f["content"]).cast("bigint").alias("size")
    )
    named = archives.withColumn("stored", F.transform("files", of_file))
    core = F.to_json(F.struct("archive_id", "archived_at", F.col("stored").alias("files"), "invoice_number", "operation", "owner_id"), {"ignoreNullFields": "false"})
    return named.withColumn("core", core).withColumn("manifest_sha256", F.sha2(F.col("core").cast("binary"), 256))


#: lines of one chain that a single task sorts
MOST_LINKED = 1_000_000
LINES = "chain string, seq bigint, archive_id string, prev_hash string, entry_hash string, line string"


def linked(manifests: DataFrame, last: DataFrame | None = None, most: int = MOST_LINKED) -> DataFrame:
    """LINES of ledger entries appended in order of `seq`. manifests: chain, seq, archive_id, archived_at, owner_id, manifest_sha256.

    last: chain, entry_hash of the ledger's last line so far; a chain without one begins anew. One task a chain, in which rows stream; chains of
    more than `most` lines are dealt into ranges, which are linked one after another, each from the last hash of the one before. The text of a line is
    made beforehand by all tasks, so that the sequential part only hashes it. Lines lie in files in the shared folder; calling this writes them.
    """
    # the texts on both sides of where a line has its entry_hash, in canonical order; only the outer braces go
    bare = lambda *names: F.regexp_replace(F.to_json(F.struct(*[F.col(n).cast("string").alias(n) for n in names]), {"ignoreNullFields": "false"}), r"^\{|\}$", "")
    head, tail = F.concat(F.lit("{"), bare("archive_id", "archived_at"), F.lit(",")), F.concat(bare("manifest_sha256", "owner_id"), F.lit(","))
    keys = [F.col(n).cast(kind).alias(n) for n, kind in (("chain", "string"), ("seq", "bigint"), ("archive_id", "string"))]
    rows = manifests.select(*keys, head.alias("head"), tail.alias("tail"))
    if last is not None:
        rows = rows.join(last.select("chain", F.col("entry_hash").alias("begun")), "chain", "left")
    rows = rows.withColumn("begun", F.lit(GENESIS) if last is None else F.coalesce("begun", F.lit(GENESIS))).select("chain", "seq", "archive_id", "head", "tail", "begun")

    def small(text):
        """Escapes of control characters as Python writes them, in small letters."""
        return re.sub(r"\\(?:u00[0-9A-F]{2}|.)", lambda m: m[0].lower() if m[0][1] == "u" else m[0], text)

    def link(batches):
        chain, before = object(), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            of, head, tail = (batch.column(k) for k in (0, 3, 4))
            if any(pc.any(pc.match_substring(c, "\\u00")).as_py() for c in (head, tail)):
                head, tail = (pa.array([small(t) for t in c.to_pylist()], pa.string()) for c in (head, tail))
            # where the chain differs from the row before; nulls are a chain
            fresh = np.zeros(n, bool)
            fresh[1:] = ~pc.fill_null(pc.equal(of[1:], of[:-1]), False).to_numpy(zero_copy_only=False) & ~pc.and_(pc.is_null(of[1:]), pc.is_null(of[:-1])).to_numpy(zero_copy_only=False)
            fresh[0] = of[0].as_py() != chain
            chain = of[n - 1].as_py()
            starts = {int(k): batch.column(5)[int(k)].as_py() for k in np.flatnonzero(fresh)}
            priors, own = [], []
            for k, text in enumerate(pc.binary_join_element_wise(head, tail, pa.scalar('"prev_hash":"'), "").to_pylist()):
                before = starts.get(k, before)
                priors.append(before)
                before = hashlib.sha256(f'{text}{before}"}}'.encode()).hexdigest()
                own.append(before)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], head, tail, pa.array(priors, pa.string()), pa.array(own, pa.string())], names=_LINKED_NAMES)

    spark, place = manifests.sparkSession, folder(manifests.sparkSession, "ledger")
    kept = lambda df, name: df.mapInArrow(link, _LINKED).write.parquet(f"{place}/linked/{name}")
    read = lambda *names: spark.read.schema(_LINKED).parquet(*[f"{place}/linked/{n}" for n in names])
    by_chain = lambda df: df.repartition("chain").sortWithinPartitions("chain", "seq")
    long = manifests.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    total = long.agg(F.sum("n")).first()[0]
    if not total:
        kept(by_chain(rows), "short")
        return _lines(read("short"))
    names = F.broadcast(long.select(F.col("chain").alias("of")))  # at most total / most rows
    same = F.col("chain").eqNullSafe(F.col("of"))
    ranges = -(-total // most)
    # written before they are dealt, as dealing reads its rows twice
    rows.write.parquet(f"{place}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{place}/rows")
    dealt = rows.join(names, same, "left_semi").repartitionByRange(ranges, "chain", "seq")
    dealt.withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(f"{place}/dealt")
    parts = sorted(r["part"] for r in spark.read.parquet(f"{place}/dealt").select("part").distinct().collect())
    done = []
    for k in parts:
        part = spark.read.schema(rows.schema).parquet(f"{place}/dealt/part={k}")
        if done:
            # only the chain that goes on from the range before has a hash there
            ends = read(done[-1]).groupBy(F.col("chain").alias("of")).agg(F.max_by("entry_hash", "seq").alias("carried"))
            part = part.join(F.broadcast(ends), same, "left").withColumn("begun", F.coalesce("carried", "begun")).select(*rows.columns)
        # a range is one task's anyway: its rows need no shuffle
        kept(part.coalesce(1).sortWithinPartitions("chain", "seq"), f"part={k}")
        done.append(f"part={k}")
    kept(by_chain(rows.join(names, same, "left_anti")), "short")
    return _lines(read(*done, "short"))


#: what linking writes: a line's texts are joined when they are read
_LINKED = "chain string, seq bigint, archive_id string, head string, tail string, prev_hash string, entry_hash string"
_LINKED_NAMES = [c.split()[0] for c in _LINKED.split(", ")]


def _lines(linked: DataFrame) -> DataFrame:
    """LINES of what linking wrote."""
    line = F.concat("head", F.lit('"entry_hash":"'), "entry_hash", F.lit('",'), "tail", F.lit('"prev_hash":"'), "prev_hash", F.lit('"}'))
    return linked.select("chain", "seq", "archive_id", "prev_hash", "entry_hash", line.alias("line"))


def _numbered(text: str, n: Column) -> Column:
    before, after = text.split("{}")
    return F.concat(F.lit(before), n.cast("string"), F.lit(after))


def _told(*cases: tuple[Column, Column]) -> Column:
    return F.filter(F.array(*[F.when(when, said) for when, said in cases]), lambda x: x.isNotNull())


def _plain(text: Column, read: Column) -> Column:
    """Whether a struct read from JSON text is all of it: written again it is the same text, without escapes.

    Such a text, with its keys in canonical order, is canonical as it stands.
    """
    return F.coalesce((F.to_json(read, {"ignoreNullFields": "false"}) == text) & ~text.contains("\\"), F.lit(False))


_SAID = ("archive_id", "owner_id", "archived_at", "manifest_sha256", "prev_hash")
_ENTRY = "archive_id string, archived_at string, entry_hash string, manifest_sha256 string, owner_id string, prev_hash string"


def _known(lines: DataFrame) -> DataFrame:
    """What lines say instead of `line`, and whether their hash holds; only lines that are not written as linked() does become variants."""
    keys, line, entry, document = [c for c in lines.columns if c != "line"], F.col("line"), F.col("entry"), F.col("document")
    read = lines.select(*keys, "line", F.from_json("line", _ENTRY).alias("entry"))
    read = read.withColumn("plain", _plain(line, entry) & entry["entry_hash"].isNotNull())
    read = read.withColumn("document", F.when(~F.col("plain"), _object(line)))
    said = lambda n: F.when(F.col("plain"), entry[n]).otherwise(_string(document, n))
    # quotes stand only around keys and texts here, so the key is found once
    bare = F.replace(line, F.concat(F.lit('"entry_hash":"'), entry["entry_hash"], F.lit('",')), F.lit(""))
    own = F.sha2(F.when(F.col("plain"), bare).otherwise(canonical(document, without=("entry_hash",))).cast("binary"), 256)
    return read.select(*keys, said("entry_hash").alias("entry_hash"), (own == said("entry_hash")).alias("held"), *[said(n).alias(n) for n in _SAID])


def checked(lines: DataFrame, ranges: int | None = None) -> DataFrame:
    """chain, line_no, archive_id, owner_id, archived_at, manifest_sha256, entry_hash and problems of each ledger line.

    lines: chain, line_no (from 1), line; without line_no they are numbered by `seq`, in the same ranges.
    """
    order = "line_no" if "line_no" in lines.columns else "seq"
    known = prefix.spread(lines.select("chain", order, "line"), ["chain"], [order], ranges, _known)
    if order == "seq":
        known = prefix.sums(known, ["chain"], [order], {"line_no": F.lit(1)})
    placed = prefix.done(prefix.before(known, ["chain"], [order], {"before": F.struct("entry_hash")}))
    n, readable = F.col("line_no"), F.col("entry_hash").isNotNull()
    # no line before: the chain begins; an unreadable one: nothing to compare with
    wanted = F.when(F.col("before").isNull(), F.lit(GENESIS)).otherwise(F.col("before.entry_hash"))
    apart = wanted.isNotNull() & ~F.col("prev_hash").eqNullSafe(wanted)
    problems = _told((~readable, _numbered(UNREADABLE, n)), (readable & ~F.coalesce("held", F.lit(False)), _numbered(MODIFIED, n)), (readable & apart, _numbered(BROKEN, n)))
    return placed.select("chain", "line_no", *_SAID[:-1], "entry_hash", problems.alias("problems"))


#: a manifest as it is stored: what sealed() writes, its hash and those of its line
_FILE = "content_type string, filename string, role string, sha256 string, size bigint"
_CORE = f"archive_id string, archived_at string, files array<struct<{_FILE.replace(' ', ': ').replace(',:', ',')}>>, invoice_number string, operation string, owner_id string"
_MANIFEST = f"{_CORE}, manifest_sha256 string, prev_hash string, entry_hash string"


def _named(manifests: DataFrame) -> DataFrame:
    """What manifests say, the hash of their core and their files; only texts that are not written as in _MANIFEST become variants."""
    text, read, m = F.col("manifest"), F.col("read"), F.col("m")
    d = manifests.select("archive_id", "manifest", F.from_json("manifest", _MANIFEST).alias("read")).withColumn("plain", _plain(text, read))
    d = d.withColumn("m", F.when(~F.col("plain"), _object(text)))
    said = lambda n: F.when(F.col("plain"), read[n]).otherwise(_string(m, n))
    core = F.to_json(F.struct(*[read[n].alias(n) for n in CORE]), {"ignoreNullFields": "false"})
    own = F.sha2(F.when(F.col("plain"), core).otherwise(canonical(m, only=CORE)).cast("binary"), 256)
    names = [c.split(":")[0] for c in FILE.removeprefix("array<struct<").split(", ")]
    files = F.transform(read["files"], lambda f: F.struct(*[f[n].alias(n) for n in names]))
    listed = F.when(F.col("plain"), files).otherwise(F.try_variant_get(m["files"], "$", FILE))
    return d.select("archive_id", *[said(n).alias(n) for n in ("owner_id", "manifest_sha256", "entry_hash")], own.alias("own"), listed.alias("listed"))


def verified(manifests: DataFrame, files: DataFrame, ledger: DataFrame) -> DataFrame:
    """archive_id, owner_id, entry_hash, problems (its own), chain_problems (how many its chain has) and intact, of each archive with a manifest or a ledger entry.

    manifests: archive_id, manifest (JSON text); files: archive_id, filename, sha256 (of what is stored now); ledger: checked().
    """
    entries = ledger.where("entry_hash is not null and archive_id is not null")
    last = entries.groupBy("archive_id").agg(F.max_by(F.struct("chain", "owner_id", "manifest_sha256", "entry_hash"), F.struct("chain", "line_no")).alias("entry"))
    chains = ledger.groupBy("chain").agg(F.sum(F.size("problems")).cast("bigint").alias("chain_problems"))
    named = cut(_named(manifests))  # read for its files and for what it says
    wanted = named.select("archive_id", F.posexplode("listed").alias("place", "f")).select("archive_id", "place", F.col("f.filename").alias("filename"), F.col("f.sha256").alias("noted"))
    met = wanted.join(files.select("archive_id", "filename", F.col("sha256").alias("found")), ["archive_id", "filename"], "left")
    wrong = F.when(F.col("found").isNull(), _numbered(MISSING, F.col("filename"))).when(F.col("found") != F.col("noted"), _numbered(MISMATCH, F.col("filename")))
    wrong = met.groupBy("archive_id").agg(F.transform(F.sort_array(F.collect_list(F.when(wrong.isNotNull(), F.struct("place", wrong.alias("said"))))), lambda x: x["said"]).alias("of_files"))
    both = named.join(wrong, "archive_id", "left").withColumn("there", F.lit(True)).join(last, "archive_id", "full")
    there, entry = F.coalesce("there", F.lit(False)), F.col("entry")
    same = entry["manifest_sha256"].eqNullSafe(F.col("manifest_sha256")) & entry["entry_hash"].eqNullSafe(F.col("entry_hash"))
    own = _told(
        (~there, F.lit(DELETED)),
        (there & ~F.col("own").eqNullSafe(F.col("manifest_sha256")), F.lit(CHANGED)),
        (there & entry.isNull(), F.lit(NO_ENTRY)),
        (there & entry.isNotNull() & ~same, F.lit(DIFFERS)),
    )
    problems = F.concat(F.coalesce("of_files", F.array().cast("array<string>")), own)
    out = both.select("archive_id", F.when(there, F.col("owner_id")).otherwise(entry["owner_id"]).alias("owner_id"), F.when(there, F.col("entry_hash")).otherwise(entry["entry_hash"]).alias("entry_hash"), problems.alias("problems"), entry["chain"].alias("chain"))
    out = out.join(chains, "chain", "left")
    broken = F.coalesce("chain_problems", F.lit(0))
    return out.select("archive_id", "owner_id", "entry_hash", "problems", broken.alias("chain_problems"), ((F.size("problems") == 0) & (broken == 0)).alias("intact"))
