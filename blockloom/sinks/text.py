"""Dumps as ordered lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


#: Attributes that hold numbers only.
NUMBERS = {"origin_block", "data_block", "time", "origin_begin", "data_begin", "length", "begin", "left_data_begin", "right_data_begin", "dev_id", "cache_block", "block", "era", "block_begin", "len"}


def escaped(v: Column) -> Column:
    """A value as it may stand in an attribute."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\n", "&#10;"), ("\t", "&#9;")):
        v = F.replace(v, F.lit(raw), F.lit(safe))
    return v


def element(tag: str, end: str = "/>", indent: int = 0, **attributes) -> Column:
    """An XML element with attributes in the order given; those that are null are left out."""
    parts = [F.concat(F.lit(f' {k}="'), v.cast("string") if k in NUMBERS else escaped(v.cast("string")), F.lit('"')) for k, v in attributes.items()]
    return F.concat(F.lit(" " * indent + f"<{tag}"), F.concat_ws("", *parts), F.lit(end))


def _ordered(*parts: DataFrame) -> DataFrame:
    """line in order of (a, b, c, d); a sort by range, so that written files follow each other."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("a", "b", "c", "d").select("line")


def _at(df: DataFrame, line: Column, a, b, c, d=0) -> DataFrame:
    long = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("long")
    return df.select(long(a).alias("a"), long(b).alias("b"), long(c).alias("c"), long(d).alias("d"), line.alias("line"))


def run_element(indent: int = 4) -> Column:
    c = F.col
    one = element("single_mapping", indent=indent, origin_block=c("thin_begin"), data_block=c("data_begin"), time=c("map_time"))
    more = element("range_mapping", indent=indent, origin_begin=c("thin_begin"), data_begin=c("data_begin"), length=c("len"), time=c("map_time"))
    return F.when(c("len") == 1, one).otherwise(more)


def thin_xml(sb: DataFrame, devices: DataFrame, runs: DataFrame) -> DataFrame:
    """Lines of a volume dump. sb has uuid, time, transaction, version, data_block_size, nr_data_blocks and maybe flags, metadata_snap."""
    c = F.col
    opt = lambda n: {n: c(n)} if n in sb.columns else {}
    head = element("superblock", ">", uuid=c("uuid"), time=c("time"), transaction=c("transaction"), **opt("flags"), version=F.coalesce(c("version"), F.lit(2)) if "version" in sb.columns else F.lit(2),
                   data_block_size=c("data_block_size"), nr_data_blocks=c("nr_data_blocks"), **opt("metadata_snap"))
    dev = element("device", ">", 2, dev_id=c("dev_id"), mapped_blocks=c("mapped_blocks"), transaction=c("transaction_id"), creation_time=c("creation_time"), snap_time=c("snapshotted_time"))
    return _ordered(
        _at(sb, head, 0, 0, 0), _at(devices, dev, 1, c("dev_id"), 0), _at(runs, run_element(), 1, c("dev_id"), 1, c("thin_begin")),
        _at(devices, F.lit("  </device>"), 1, c("dev_id"), 2), _at(sb, F.lit("</superblock>"), 2, 0, 0))


def thin_readable(devices: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs as inclusive ranges, under their device."""
    c = F.col
    text = F.format_string("    (%d..%d) -> (%d..%d), %d", c("thin_begin"), c("thin_begin") + c("len") - 1, c("data_begin"), c("data_begin") + c("len") - 1, c("map_time"))
    names = {"device": "dev_id", "mapped_blocks": "mapped_blocks", "transaction": "transaction_id", "creation time": "creation_time", "snap time": "snapshotted_time"}
    heads = [_at(devices, F.format_string(f"{k}: %d", c(v)), 0, c("dev_id"), 0, i) for i, (k, v) in enumerate(names.items())]
    return _ordered(*heads, _at(runs, text, 0, c("dev_id"), 1, c("thin_begin")), _at(devices, F.lit(""), 0, c("dev_id"), 2))


#: Element of each kind of delta (fixed values of the format).
DELTA_TAGS = {"left_only": "left_only", "right_only": "right_only", "same": "same", "differ": "different"}


def delta_xml(delta: DataFrame, sb: DataFrame | None = None, left: int | None = None, right: int | None = None, verbose: bool = False) -> DataFrame:
    """Lines of a delta (kind, thin_begin, len); with sb (uuid, time, transaction, data_block_size, nr_data_blocks) as a whole document.

    verbose: each piece is a range with its data blocks (data_begin, or left_data_begin and right_data_begin), in an element for each
    stretch of pieces of one kind.
    """
    c = F.col
    body = None
    if verbose:
        # A stretch begins where the kind changes; the pieces come in order of thin_begin.
        w = Window.orderBy("thin_begin")
        x = delta.withColumn("opens", ~c("kind").eqNullSafe(F.lag("kind").over(w))).withColumn("closes", ~c("kind").eqNullSafe(F.lead("kind").over(w)))
        tag = F.element_at(F.create_map(*(F.lit(v) for kv in DELTA_TAGS.items() for v in kv)), c("kind"))
        differ = element("range", indent=6, begin=c("thin_begin"), left_data_begin=c("left_data_begin"), right_data_begin=c("right_data_begin"), length=c("len"))
        same = element("range", indent=6, begin=c("thin_begin"), data_begin=c("data_begin"), length=c("len"))
        body = [_at(x.filter("opens"), F.concat(F.lit("    <"), tag, F.lit(">")), 1, c("thin_begin"), 0), _at(x, F.when(c("kind") == "differ", differ).otherwise(same), 1, c("thin_begin"), 1),
                _at(x.filter("closes"), F.concat(F.lit("    </"), tag, F.lit(">")), 1, c("thin_begin"), 2)]
    else:
        line = None
        for kind, tag in DELTA_TAGS.items():
            e = element(tag, indent=2 if sb is None else 4, begin=c("thin_begin"), length=c("len"))
            line = F.when(c("kind") == kind, e) if line is None else line.when(c("kind") == kind, e)
        body = [_at(delta, line, 1, c("thin_begin"), 0)]
    if sb is None:
        return _ordered(*body)
    head = element("superblock", ">", **{n: c(n) for n in ("uuid", "time", "transaction", "data_block_size", "nr_data_blocks")})
    diff = element("diff", ">", 2, left=F.lit(left), right=F.lit(right))
    return _ordered(_at(sb, head, 0, 0, 0), _at(sb, diff, 0, 1, 0), *body, _at(sb, F.lit("  </diff>"), 2, 0, 0), _at(sb, F.lit("</superblock>"), 3, 0, 0))


def cache_xml(sb: DataFrame, mappings: DataFrame, hints: DataFrame) -> DataFrame:
    c = F.col
    head = element("superblock", ">", uuid=c("uuid"), block_size=c("block_size"), nr_cache_blocks=c("nr_cache_blocks"), policy=c("policy"), hint_width=c("hint_width"))
    fixed = lambda text, a, b: _at(sb, F.lit(text), a, b, 0)
    m = element("mapping", indent=4, cache_block=c("cblock"), origin_block=c("oblock"), dirty=(c("is_dirty") == 1))
    h = element("hint", indent=4, cache_block=c("cblock"), data=F.base64("hint"))
    return _ordered(_at(sb, head, 0, 0, 0), fixed("  <mappings>", 1, 0), _at(mappings, m, 1, 1, c("cblock")), fixed("  </mappings>", 1, 2),
                    fixed("  <hints>", 2, 0), _at(hints, h, 2, 1, c("cblock")), fixed("  </hints>", 2, 2), fixed("</superblock>", 3, 0))


def era_xml(sb: DataFrame, eras: DataFrame, marked: DataFrame, array: DataFrame, compact: bool = True) -> DataFrame:
    """Marked ranges (era, begin, end) or, if not compact, every bit of every writeset with its value."""
    c = F.col
    head = element("superblock", ">", uuid=c("uuid"), block_size=c("block_size"), nr_blocks=c("nr_blocks"), current_era=c("current_era"))
    ws = element("writeset", ">", 2, era=c("era"), nr_bits=c("nr_bits"))
    mk = element("marked", indent=4, block_begin=c("begin"), len=c("end") - c("begin"))
    fixed = lambda text, a: _at(sb, F.lit(text), a, 0, 0)
    body = _at(marked, mk, 1, c("era"), 1, c("begin"))
    if not compact:
        places = lambda a, b: F.explode(F.sequence(a, b - 1)).alias("bit")
        on = marked.select("era", places(c("begin"), c("end"))).withColumn("on", F.lit(True))
        bits = eras.filter("nr_bits > 0").select("era", places(F.lit(0).cast("long"), c("nr_bits").cast("long"))).join(on, ["era", "bit"], "left")
        body = _at(bits, element("bit", indent=4, block=c("bit"), value=F.coalesce("on", F.lit(False))), 1, c("era"), 1, c("bit"))
    return _ordered(_at(sb, head, 0, 0, 0), _at(eras, ws, 1, c("era"), 0), body, _at(eras, F.lit("  </writeset>"), 1, c("era"), 2),
                    fixed("  <era_array>", 2), _at(array, element("era", indent=4, block=c("block"), era=c("era")), 3, 0, c("block")), fixed("  </era_array>", 4), fixed("</superblock>", 5))


def join_files(spark: SparkSession, parts: str, path: str) -> None:
    """The files of a folder in order of name as one file; the folder goes. Bytes are copied by the driver's JVM."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, at = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    names = sorted((s.getPath().getName() for s in fs.listStatus(folder)), key=lambda n: (len(n.split("-")[1]) if n.startswith("part-") else 0, n))
    out = fs.create(at, True)
    try:
        for name in names:
            if name.startswith("part-"):
                part = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
    finally:
        out.close()
    fs.delete(folder, True)


def grid(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows right-justified to the widest cell of each column, names first; each cell is followed by a space. The widths are one aggregate row."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    ranked = df.select(F.struct(*order).alias("_o"), F.struct(*cells).alias("_t"))
    widths = ranked.agg(*(F.coalesce(F.greatest(F.max(F.length(F.col("_t")[c])), F.lit(len(c))), F.lit(len(c))).alias(f"_w{i}") for i, c in enumerate(df.columns)))
    pad = lambda v, i: F.concat(F.expr("''"), F.lpad(v, F.col(f"_w{i}"), F.lit(" ")), F.lit(" "))
    body = ranked.join(F.broadcast(widths)).select(F.lit(1).alias("_s"), "_o", F.concat(*(pad(F.col("_t")[c], i) for i, c in enumerate(df.columns))).alias("line"))
    head = widths.select(F.lit(0).alias("_s"), F.lit(None).cast(body.schema["_o"].dataType).alias("_o"), F.concat(*(pad(F.lit(c), i) for i, c in enumerate(df.columns))).alias("line"))
    return head.unionByName(body).orderBy("_s", "_o").select("line")
