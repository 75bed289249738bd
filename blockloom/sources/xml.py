"""XML dumps of volumes, caches and eras as relations. Rows are devices, runs, writesets and so on; attributes are strict.

A dump of volumes is read tag by tag (`<` cannot stand inside one), so a file is cut into splits like any text and no element is held
whole. One pass finds what each split does to the place in the document, one row for each; the driver strings these together.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Attributes of each element: required, then optional (fixed values of the format).
ATTRIBUTES = {
    "thin": {"superblock": (["uuid", "time", "transaction", "data_block_size", "nr_data_blocks"], ["flags", "version", "metadata_snap"]),
             "device": (["dev_id", "mapped_blocks", "transaction", "creation_time", "snap_time"], []), "def": (["name"], [])},
    "cache": {"superblock": (["uuid", "block_size", "nr_cache_blocks", "policy", "hint_width"], []), "mapping": (["cache_block", "origin_block", "dirty"], []), "hint": (["cache_block", "data"], [])},
    "era": {"superblock": (["uuid", "block_size", "nr_blocks", "current_era"], []), "writeset": (["era", "nr_bits"], [])},
}
TEXT = {"uuid", "policy", "name"}
#: Elements of mappings; they and refs are empty ones.
MAPPINGS = {"single_mapping": ["origin_block", "data_block", "time"], "range_mapping": ["origin_begin", "data_begin", "length", "time"]}
TAGS = {**ATTRIBUTES["thin"], **{t: (a, []) for t, a in MAPPINGS.items()}, "ref": (["name"], [])}

#: Kinds of tags and, by kind: the place after it (-1: as before), the places where it may stand as bits.
OTHER, MAPPING, REF, DEVICE, DEF, SUPERBLOCK = 0, 1, 2, (3, 4, 5), (6, 7, 8), (9, 10, 11)  # opened, closed, empty
START, BODY, IN_DEVICE, IN_DEF, END, UNKNOWN = range(6)
_AFTER = np.array([-1, -1, -1, IN_DEVICE, BODY, BODY, IN_DEF, BODY, BODY, BODY, END, END])
_MAY_STAND = np.array([31, 12, 12, 2, 4, 2, 2, 8, 2, 1, 2, 1])
_OWNERS = (DEVICE[0], DEF[0])

_QUOTED = r"""(?:"[^"]*"|'[^']*')"""
_PAIR = re.compile(rf"""\s+([^\s=/>"']+)\s*=\s*({_QUOTED})""")
_TAG = re.compile(rf"""(/?)([^\s/>]+)((?:\s+[^\s=/>"']+\s*=\s*{_QUOTED})*)\s*(/?)>""")
_ENTITY = re.compile("&([^;&]*)(;?)")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
RUN = ["thin_begin", "data_begin", "len", "map_time"]


def _text(raw: str) -> str:
    def one(m) -> str:
        name, ended = m.groups()
        if ended and name in _NAMED:
            return _NAMED[name]
        if ended and re.fullmatch("#x[0-9A-Fa-f]+|#[0-9]+", name):
            return chr(int(name[2:], 16) if name[1] == "x" else int(name[1:]))
        raise ValueError(f"unknown entity &{name}")

    return _ENTITY.sub(one, re.sub("\r\n|[\t\r\n]", " ", raw))


def _number(raw: str) -> int:
    if not re.fullmatch(r"\+?[0-9]+", raw) or int(raw) >= 1 << 63:
        raise ValueError("no number below 2^63")
    return int(raw)


def _read_tag(tag: str, strict: bool) -> tuple[int, dict]:
    """Kind and attributes of what follows a `<`. Whatever is wrong raises."""
    if tag[0] == "?" and "?>" in tag and re.search(r"""\sencoding\s*=\s*["'](?!utf-8["']|us-ascii["'])""", tag, re.I) is None:
        return OTHER, {}
    m = _TAG.match(tag)
    close, name, pairs, alone = m.groups() if m else ("", "", "", "")
    if name not in TAGS:
        raise ValueError(f"malformed or unknown: <{tag[:80]}")
    form = 1 if close else 2 if alone else 0
    kinds = {"device": DEVICE, "def": DEF, "superblock": SUPERBLOCK}.get(name)
    if form == 1 and (pairs or alone) or kinds is None and form != 2:
        raise ValueError(f"{name}: malformed")
    if form == 1:
        return kinds[1], {}
    required, optional = TAGS[name]
    found = _PAIR.findall(pairs)
    raw = {k: v[1:-1] for k, v in found}
    if len(raw) < len(found):
        raise ValueError(f"{name}: an attribute twice")
    if strict and (bad := sorted(set(raw) - set(required + optional))):
        raise ValueError(f"{name}: unknown attributes {bad}")
    values = {}
    for a in required + optional:
        if a in raw:
            try:
                values[a] = _text(raw[a]) if a in TEXT else _number(raw[a])
            except (ValueError, OverflowError) as e:
                raise ValueError(f"{name}: attribute {a}: {e}") from e
        elif a in required:
            raise ValueError(f"{name}: attribute {a} is missing")
    return (kinds[form] if kinds else REF if name == "ref" else MAPPING), values


def _tags(spark: SparkSession, path: str) -> DataFrame:
    """All that follows a `<` (value), in order (id) within a split (file, start)."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "<").text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("id"))


def _mappings(values: pa.Array) -> tuple[np.ndarray, dict]:
    """Mappings as they are mostly written: whether each value is one, and their places and numbers, all at once. Any other spelling is left to _read_tag."""
    parts = pc.split_pattern(values, '"')
    begin, flat, found = parts.offsets.to_numpy()[:len(values)], parts.values, []
    sizes = np.diff(parts.offsets.to_numpy()[:len(values) + 1])
    for tag, names in MAPPINGS.items():
        at, n = np.flatnonzero(sizes == 2 * len(names) + 1), len(names)
        for i, text in [(0, f"{tag} {names[0]}="), *((2 * k, f" {a}=") for k, a in enumerate(names) if k)]:
            at = at[pc.equal(flat.take(pa.array(begin[at] + i)), text).to_numpy(zero_copy_only=False)]
        at = at[pc.equal(pc.ascii_trim(flat.take(pa.array(begin[at] + 2 * n)), " \t\r\n"), "/>").to_numpy(zero_copy_only=False)]
        for k in range(n):
            x = flat.take(pa.array(begin[at] + 2 * k + 1))
            at = at[pc.and_(pc.ascii_is_decimal(x), pc.less(pc.binary_length(x), 19)).to_numpy(zero_copy_only=False)]
        numbers = [flat.take(pa.array(begin[at] + 2 * k + 1)).cast(pa.int64()).to_numpy() for k in range(n)]
        found.append((at, numbers if n == 4 else [*numbers[:2], np.ones(len(at), np.int64), numbers[2]]))
    mask = np.zeros(len(values), bool)
    for at, _ in found:
        mask[at] = True
    return mask, found


def _filled(x: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Before and after each row: the latest value that is not -1, at first the one given."""
    at = np.maximum.accumulate(np.where(x >= 0, np.arange(len(x)), -1))
    after = np.where(at >= 0, x[at], first)
    return np.concatenate([[first], after[:-1]]), after


def _pieces(batches, strict: bool):
    """Pieces of batches that lie in one split: the split (file, start), whether the piece begins it, ids, kinds, comment marks (1 begins, 0 ends, -1), the numbers
    of plain mappings and {row: (attributes, fault)} of other tags."""
    last = None
    for batch in batches:
        file, start = batch.column("file"), batch.column("start").to_numpy()
        code = file.dictionary_encode().indices.fill_null(-1).to_numpy()
        cuts = [0, *(np.flatnonzero((start[1:] != start[:-1]) | (code[1:] != code[:-1])) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            piece, split = batch.slice(a, b - a), (file[a].as_py(), int(start[a]))
            first, last = split != last, split
            tags = piece.column("value")
            plain, numbers = _mappings(pa.concat_arrays([tags]))
            kind, mark, read = np.full(b - a, MAPPING), np.full(b - a, -1), {}
            for i in np.flatnonzero(~plain).tolist():
                tag, kind[i] = tags[i].as_py(), OTHER
                if not tag.strip("\ufeff \t\r\n"):
                    if not (first and split[1] == 0 and i == 0):
                        read[i] = None, "a < without a tag"
                    continue
                begins = tag.startswith("!--")
                if tag.find("-->", 3 if begins else 0) >= 0:
                    mark[i] = 0
                elif begins:
                    mark[i] = 1
                if begins:
                    read[i] = None, None
                    continue
                try:
                    kind[i], values = _read_tag(tag, strict)
                    read[i] = values, None
                except ValueError as e:
                    read[i] = None, str(e)
            if first and split[1] == 0 and (plain[0] or 0 in read):
                kind[0], mark[0], read[0] = OTHER, -1, (None, "text before the first tag")
            yield split, first, piece, kind, mark, numbers, read


def _outside(kind, mark, read, comment: int):
    """Kinds where those inside comments are OTHER, whether each row is inside one, and whether one is open behind."""
    before, after = _filled(mark, comment)
    return np.where(before == 1, OTHER, kind), before == 1, int(after[-1])


def _owner(values: dict) -> str:
    return str(values["dev_id"] if "dev_id" in values else values["name"])


_SUMMARY = pa.schema([("file", pa.string()), ("start", pa.int64()), ("inside", pa.int32()), ("comment", pa.int32()), ("place", pa.int32()), ("owner", pa.string()), ("begins", pa.int32()), ("fault", pa.string())])


def _summary(batches, strict: bool):
    """For each split, beginning outside (0) or inside (1) a comment: what it leaves, the places where it may begin (bits), its first fault."""
    cases, at = [], None
    row = lambda: pa.RecordBatch.from_pylist([{"file": at[0], "start": at[1], "inside": h, **s} for h, s in enumerate(cases)], schema=_SUMMARY)
    for split, first, _, kind, mark, _, read in _pieces(batches, strict):
        if first:
            if cases:
                yield row()
            at, cases = split, [{"comment": h, "place": UNKNOWN, "owner": None, "begins": 31, "fault": None} for h in (0, 1)]
        for s in cases:
            k, inside, comment = _outside(kind, mark, read, s["comment"])
            before, after = _filled(_AFTER[k], s["place"])
            s["begins"] &= int(np.bitwise_and.reduce(_MAY_STAND[k][before == UNKNOWN], initial=31))
            faults = {int(i): "a tag stands where it may not" for i in np.flatnonzero((before != UNKNOWN) & (_MAY_STAND[k] >> before & 1 == 0))[:1]}
            for i, (values, fault) in read.items():
                if fault and not inside[i]:
                    faults[i] = fault
                elif inside[i] and values is None and not fault:
                    faults[i] = "a comment in a comment"
                elif k[i] in _OWNERS:
                    s["owner"] = _owner(values)
            if faults and s["fault"] is None:
                s["fault"] = faults[min(faults)]
            s["comment"], s["place"] = comment, int(after[-1])
    if cases:
        yield row()


def _places(spark: SparkSession, path: str, strict: bool) -> list[tuple]:
    """Where each split of a dump begins: file, start, comment, place, owner. Whatever is wrong with a tag or where it stands raises."""
    found = {}
    for r in _tags(spark, path).select("file", "start", "value").mapInArrow(lambda b: _summary(b, strict), "file string, start long, inside int, comment int, place int, owner string, begins int, fault string").collect():
        found.setdefault(r.file, {})[r.start, r.inside] = r
    rows = []
    for file, splits in found.items():
        comment, place, owner = 0, START, None
        for start in sorted({s for s, _ in splits}):
            rows.append((file, start, comment, place, owner))
            r = splits[start, comment]
            if r.fault is not None or not r.begins >> place & 1:
                raise ValueError(r.fault or "a tag stands where it may not")
            comment, place, owner = r.comment, place if r.place == UNKNOWN else r.place, owner if r.owner is None else r.owner
        if place != END or comment:
            raise ValueError("the document is not complete")
    return rows


def _elements(spark: SparkSession, path: str, places: list[tuple], kinds: tuple, fields: dict[str, str], owner: str | None = None, within: int | None = None) -> DataFrame:
    """Elements of some kinds: the owner under the name given, if any, and the attributes asked for ({attribute: name})."""
    types = {a: pa.string() if a in TEXT else pa.int64() for a in fields}
    begins = [p[2:] for p in places]

    def fill(batches):
        comment = place = own = None
        last = -1
        for split, first, piece, kind, mark, numbers, read in _pieces(batches, False):
            ids = piece.column("id").to_numpy()
            if ids[0] <= last or (ids[1:] <= ids[:-1]).any():
                raise ValueError("tags out of order")
            last = ids[-1]
            if first:
                if split[0] is None:
                    raise ValueError("the file is cut otherwise than when it was checked; read it again")
                comment, place, own = begins[split[0]]
            k, _, comment = _outside(kind, mark, read, comment)
            before, after = _filled(_AFTER[k], place)
            owns = np.isin(k, _OWNERS)
            names = [own, *(_owner(read[i][0]) for i in np.flatnonzero(owns).tolist())]
            held, behind = _filled(np.where(owns, np.cumsum(owns), -1), 0)
            keep = np.isin(k, kinds) & ((before == within) if within is not None else True)
            at = np.flatnonzero(keep)
            out = [] if owner is None else [pa.array(names, pa.string()).take(pa.array(held[at]))]
            rare = {i: read[i][0] for i in sorted(read) if keep[i]}
            if MAPPING in kinds:
                runs = np.zeros((4, len(k)), np.int64)
                for rows, columns in numbers:
                    runs[:, rows] = columns
                for i, v in rare.items():
                    runs[:, i] = _run(v)
                out += [pa.array(c) for c in runs[:, at]]
            else:
                out += [pa.array([v.get(a) for v in rare.values()], types[a]) for a in fields]
            yield pa.RecordBatch.from_arrays(out, names=([] if owner is None else [owner]) + list(fields.values()))
            place, own = int(after[-1]), names[int(behind[-1])]

    schema = ([] if owner is None else [f"{owner} string"]) + [f"{n} {'string' if a in TEXT else 'long'}" for a, n in fields.items()]
    x = _tags(spark, path)
    if MAPPING not in kinds:  # mappings change no place
        v = F.col("value")
        x = x.filter(~(v.startswith("single_mapping ") | v.startswith("range_mapping ")) | v.contains("-->"))
    splits = spark.createDataFrame([(*p[:2], n) for n, p in enumerate(places)], "file string, start long, n int")
    return x.join(F.broadcast(splits), ["file", "start"], "left").select(F.col("n").alias("file"), "start", "id", "value").mapInArrow(fill, ", ".join(schema))


def _run(v: dict) -> tuple:
    return (v["origin_block"], v["data_block"], 1, v["time"]) if "origin_block" in v else (v["origin_begin"], v["data_begin"], v["length"], v["time"])


def _rows(spark: SparkSession, path: str, tag: str, attributes: tuple[list, list], children: str = "") -> DataFrame:
    """Elements of a tag with their attributes; a required one that is absent raises."""
    required, optional = attributes
    fields = [f"_{a} {'string' if a in TEXT else 'bigint'}" for a in required + optional]
    x = spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").schema(", ".join(fields + ([children] if children else []))).load(path)
    for a in required:
        x = x.withColumn(f"_{a}", F.when(F.col(f"_{a}").isNull(), F.raise_error(F.lit(f"{tag}: attribute {a} is missing"))).otherwise(F.col(f"_{a}")))
    return x


def unknown_attributes(spark: SparkSession, path: str, kind: str, tag: str) -> list[str]:
    """Attributes of a tag that the format does not have. Reads the file once more."""
    known = {f"_{a}" for part in ATTRIBUTES[kind][tag] for a in part}
    seen = spark.read.format("xml").option("rowTag", tag).load(path).columns
    return sorted(c[1:] for c in seen if c.startswith("_") and c not in known and c != "_corrupt_record")


def _plain(x: DataFrame, attributes: tuple[list, list]) -> DataFrame:
    return x.select(*(F.col(f"_{a}").alias(a) for a in attributes[0] + attributes[1]))


def read_thin(spark: SparkSession, path: str, strict: bool = True) -> dict[str, DataFrame]:
    """superblock, devices, runs (dev_id, ...), refs (dev_id, ref_name) and defs (def_name, ...) of a volume dump. The file is checked here, in one pass."""
    places = _places(spark, path, strict)
    same = lambda tag: {a: a for part in ATTRIBUTES["thin"][tag] for a in part}
    read = lambda *a: _elements(spark, path, places, *a)
    dev_id, run = F.col("dev_id").cast("long").alias("dev_id"), {c: c for c in RUN}
    return {
        "superblock": read((SUPERBLOCK[0], SUPERBLOCK[2]), same("superblock")), "devices": read((DEVICE[0], DEVICE[2]), same("device")),
        "runs": read((MAPPING,), run, "dev_id", IN_DEVICE).select(dev_id, *RUN), "refs": read((REF,), {"name": "ref_name"}, "dev_id", IN_DEVICE).select(dev_id, "ref_name"),
        "defs": read((MAPPING,), run, "def_name", IN_DEF),
    }


def _refuse_unknown(spark: SparkSession, path: str, kind: str) -> None:
    for tag in ATTRIBUTES[kind]:
        if bad := unknown_attributes(spark, path, kind, tag):
            raise ValueError(f"{tag}: unknown attributes {bad}")


def read_cache(spark: SparkSession, path: str, strict: bool = True) -> dict[str, DataFrame]:
    """superblock, mappings, hints and discards of a cache dump."""
    if strict:
        _refuse_unknown(spark, path, "cache")
    a = ATTRIBUTES["cache"]["superblock"]
    load = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").schema(schema).load(path)
    return {
        "superblock": _plain(_rows(spark, path, "superblock", a), a),
        "mappings": load("mapping", "_cache_block bigint, _origin_block bigint, _dirty boolean").select(F.col("_cache_block").alias("cblock"), F.col("_origin_block").alias("oblock"), F.lit(1).alias("is_valid"), F.col("_dirty").cast("int").alias("is_dirty")),
        "hints": load("hint", "_cache_block bigint, _data string").select(F.col("_cache_block").alias("cblock"), F.unbase64("_data").alias("hint")),
        "discards": load("discard", "_dbegin bigint, _dend bigint").select(F.col("_dbegin").alias("begin"), F.col("_dend").alias("end")),
    }


def read_era(spark: SparkSession, path: str, strict: bool = True) -> dict[str, DataFrame]:
    """superblock, writesets (era, block), eras (era, nr_bits) and array (block, era); both bits and marked ranges are read."""
    if strict:
        _refuse_unknown(spark, path, "era")
    a = ATTRIBUTES["era"]
    ws = _rows(spark, path, "writeset", a["writeset"], "bit array<struct<_block:bigint,_value:boolean>>, marked array<struct<_block_begin:bigint,_len:bigint>>")
    bits = ws.select(F.col("_era").alias("era"), F.explode("bit").alias("b")).filter("b._value").select("era", F.col("b._block").alias("block"))
    marked = ws.select(F.col("_era").alias("era"), F.explode("marked").alias("m")).filter("m._len > 0").select("era", F.explode(F.sequence(F.col("m._block_begin"), F.col("m._block_begin") + F.col("m._len") - 1)).alias("block"))
    array = spark.read.format("xml").option("rowTag", "era").schema("_block bigint, _era bigint").load(path)
    return {
        "superblock": _plain(_rows(spark, path, "superblock", a["superblock"]), a["superblock"]), "eras": _plain(ws, a["writeset"]),
        "writesets": bits.unionByName(marked), "array": array.select(F.col("_block").alias("block"), F.col("_era").alias("era")),
    }
