"""Chunking of datasheet texts and training records (CHK-1 to CHK-11).

texts: (source_file, text, metadata map<string,string>). chunks: CHUNK columns. A token is a run of
non-space characters, punctuation at word ends split off; this regular expression stands in for a
tokenizer that is not part of Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ohmlake.functions.columns import blocks_of, cut, has_any, let, match_spans, running_sums, strip

# Sizes in tokens, and the least characters of a chunk and of an introduction.
CHUNK_SIZE, OVERLAP = 512, 50
LEAST_CHUNK, LEAST_INTRO = 50, 100

TOKEN = r"(?U)(\w+(?:[.,'\-/]\w+)*|[^\w\s])"

# Titles of section headers, and what follows a title.
SECTION_TITLES = [
    r"specifications?|spec",
    r"electrical\s+characteristics?",
    r"mechanical\s+data",
    r"pin\s+configuration",
    r"functional\s+description",
    r"operating\s+conditions?",
    r"absolute\s+maximum\s+ratings?",
    r"package\s+information",
    r"application\s+information",
    r"typical\s+applications?",
]
AFTER_TITLE = r"\s*:?\s*\n"

# Words in a title for each section type, first rule first.
SECTION_TYPES = [
    ("specifications", ["spec", "electrical", "parameter"]),
    ("mechanical", ["mechanical", "package", "dimension"]),
    ("pinout", ["pin", "connection"]),
    ("description", ["functional", "operation", "description"]),
    ("application", ["application", "typical", "example"]),
]

# Parameter families.
PARAMETERS = [
    r"(voltage|vcc|vdd|supply)\s*[:\-=]\s*([0-9.]+\s*[mv]?v?)",
    r"(current|icc|idd)\s*[:\-=]\s*([0-9.]+\s*[μmuna]?a)",
    r"(temperature|temp)\s*[:\-=]\s*([-0-9.]+\s*[°]?c)",
    r"(frequency|freq|clock)\s*[:\-=]\s*([0-9.]+\s*[kmg]?hz)",
    r"(size|dimension|width|height|length)\s*[:\-=]\s*([0-9.]+\s*[μmcin]+)",
    r"(package|housing)\s*[:\-=]\s*([a-z0-9\-]+)",
]
CONTEXT = 200

CHUNK = ["id", "source_file", "chunk_type", "section", "subsection", "chunk_index", "text", "metadata", "component_name", "manufacturer"]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1))


def _chunk(df: DataFrame, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    base = {"section": none, "subsection": none, "chunk_index": F.lit(0), "component_name": none, "manufacturer": none, "metadata": F.col("metadata"), "source_file": F.col("source_file")} | columns
    return df.select(*[base[c].alias(c) for c in CHUNK])


def section_type(title: Column) -> Column:
    """CHK-5."""
    low, out = F.lower(title), None
    for kind, words in SECTION_TYPES:
        out = F.when(has_any(low, words), kind) if out is None else out.when(has_any(low, words), kind)
    return out.otherwise("general")


def windows(df: DataFrame, token_array: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """CHK-6: df with (offset, piece): windows of ``size`` tokens every size - overlap; a text without tokens has none."""
    if size <= overlap:
        raise ValueError("the overlap must be smaller than the size")
    n = F.size(token_array)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap)))
    out = df.withColumn("offset", F.explode(starts))
    return out.withColumn("piece", F.array_join(F.slice(token_array, F.col("offset") + 1, F.lit(size)), " "))


def sliding_window(texts: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """CHK-2: windows of more than LEAST_CHUNK characters; the id has the token offset, the index counts steps."""
    own = windows(texts.withColumn("_tokens", tokens(F.col("text"))), "_tokens", size, overlap)
    own = own.where(F.length(F.trim("piece")) > LEAST_CHUNK)
    return _chunk(own, id=F.concat("source_file", F.lit("_slide_"), F.col("offset").cast("string")), chunk_type=F.lit("sliding_window"), chunk_index=(F.col("offset") / (size - overlap)).cast("int"), text=F.col("piece"))


#: Python's white space, and what its case-blind letters match besides the two cases.
_SPACE = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_ODD_CASES = {"i": "\u0130\u0131", "k": "\u212A", "s": "\u017F"}


def _searched(words: list[str], pattern: str) -> str:
    """A case-blind pattern that begins with one of the words, as Python reads it.

    Most places are passed by after two or three plain letters, most others after the first three letters of the words one by one. Odd
    cases are one range in the plain letters: Java looks up letters below 256 in a table, and asks for each further one in turn.
    """
    cases = lambda n, own: sorted({c for w in own for c in (w[n], w[n].upper(), *_ODD_CASES.get(w[n], ""))})
    plain = lambda own: "[" + "".join(c for c in own if c < "\x80") + ("\u0130-\u212A" if max(own) > "\x80" else "") + "]"
    starts = "|".join(dict.fromkeys("".join("[" + "".join(cases(n, [w])) + "]" for n in range(3)) for w in words))
    return "(?d)(?=" + "".join(plain(cases(n, words)) for n in range(3)) + f")(?={starts})(?iu)" + pattern.replace(r"\s", _SPACE)


def sections(text: Column) -> Column:
    """array<struct<start, head, title, piece>>: headers by place, each with its piece, the text up to the next header's start.

    The first entry is what stands before the first header, with an empty head. As titles begin with different words, no two
    headers start at one place, and none within another of its kind. Headers of different kinds may overlap, so a head may reach
    over its piece into the next two, as titles have three words at most. The text is cut where a header starts, in one pass.
    """
    words = "|".join(SECTION_TITLES).split("|")
    header = f"({'|'.join(SECTION_TITLES)}){AFTER_TITLE}"
    ahead = _searched(words, f"(?={header})")
    # empty where no header is at the start: a pattern that fails there would be tried at every other place as well
    at_start = f"^(?:({_searched(words, header)})|)"
    entry = lambda start, head, title, piece: F.struct(start.alias("start"), head.alias("head"), title.alias("title"), piece.alias("piece"))
    after = lambda p, i: F.concat(F.get(p, i), F.coalesce(F.get(p, i + 1), F.lit("")), F.coalesce(F.get(p, i + 2), F.lit("")))
    head = lambda p, i: F.when(i == 0, F.lit("")).otherwise(let(F.regexp_extract(F.get(p, i), at_start, 1), lambda h: F.when((h == "") | (F.length(h) == F.length(F.get(p, i))), F.regexp_extract(after(p, i), at_start, 1)).otherwise(h)))
    named = lambda p, at: F.transform(p, lambda x, i: let(head(p, i), lambda h: entry(F.get(at, i), h, F.regexp_extract(h, at_start, 2), x)))
    every = lambda p: let(running_sums(F.transform(p, F.length)), lambda at: named(p, at))
    # a header at the very beginning leaves no piece before it
    whole = lambda p: F.when((F.regexp_extract(F.get(p, F.lit(0)), at_start, 1) != "") | (F.regexp_extract(F.array_join(F.slice(p, 1, 3), ""), at_start, 1) != ""), F.concat(F.array(F.lit("")), p)).otherwise(p)
    return let(let(F.split(text, ahead, -1), whole), every)


def semantic(texts: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """CHK-1: bodies of sections that headers start; long bodies in windows; a long enough introduction comes last.

    A text without a header has no chunks. Ids repeat where sections of a type do, as they are names. All of it is
    column expressions; a body is cut into tokens only if it is split, and its windows are made before rows are.
    """
    if size <= overlap:
        raise ValueError("the overlap must be smaller than the size")
    step = size - overlap
    piece = lambda j, text: F.struct(j.cast("int").alias("j"), text.alias("text"))
    split = lambda t: F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), F.size(t) - 1, F.lit(step)), lambda o: piece(o / step, F.array_join(F.slice(t, o + 1, F.lit(size)), " "))))
    whole = lambda b: F.array(piece(F.lit(None), b))
    cut_up = lambda b, intro: F.when(intro | (F.length(b) <= 2 * size), whole(b)).otherwise(let(tokens(b), split))
    kept = lambda b, intro: F.when(F.length(b) > F.when(intro, LEAST_INTRO).otherwise(LEAST_CHUNK), cut_up(b, intro))
    body = lambda s: strip(F.substring(s["piece"], F.length(s["head"]) + 1, F.length(s["piece"])))
    part = lambda s, i: F.struct((i == 0).alias("intro"), s["title"].alias("title"), let(body(s), lambda b: kept(b, i == 0)).alias("pieces"))
    row = lambda p: F.transform(p["pieces"], lambda x: F.struct(p["intro"], F.when(p["intro"], "Introduction").otherwise(p["title"]).alias("title"), x["j"], x["text"]))
    parts = let(sections(F.coalesce("text", F.lit(""))), lambda own: F.when(F.size(own) > 1, F.transform(own, part)))
    rows = F.flatten(F.transform(F.filter(parts, lambda p: p["pieces"].isNotNull()), row))
    every = texts.withColumn("_c", F.explode(rows))
    intro, j = F.col("_c.intro"), F.col("_c.j")
    kind = F.when(intro, "description").otherwise(section_type(F.col("_c.title")))
    name = F.when(intro, "intro").otherwise(kind)
    return _chunk(
        every,
        id=F.concat("source_file", F.lit("_"), name, F.coalesce(F.concat(F.lit("_"), j.cast("string")), F.lit(""))),
        chunk_type=kind,
        section=F.col("_c.title"),
        text=F.col("_c.text"),
        chunk_index=F.coalesce(j, F.lit(0)),
    )


def packed(counts: Column, size: int, overlap: int) -> Column:
    """array<struct<start, end>> of runs of sentences with these token counts: up to ``size`` tokens, one sentence at least.

    A run starts at the sentence that no longer fits, or two before it where the run before has several. A fold that
    writes only when a run is full.
    """
    run = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    state = lambda i, start, n, done: F.struct(i.cast("int").alias("i"), start.cast("int").alias("start"), n.cast("int").alias("n"), done.alias("done"))
    before = lambda i, k: F.coalesce(F.get(counts, i - k), F.lit(0))

    def add(s: Column, n: Column) -> Column:
        i, back = s["i"], (s["i"] - s["start"] > 1) & F.lit(overlap > 0)
        full = state(i + 1, F.when(back, i - 2).otherwise(i), F.when(back, before(i, 2) + before(i, 1)).otherwise(0) + n, F.concat(s["done"], F.array(run(s["start"], i))))
        return F.when((s["n"] + n > size) & (i > s["start"]), full).otherwise(state(i + 1, s["start"], s["n"] + n, s["done"]))

    none = state(F.lit(0), F.lit(0), F.lit(0), F.array().cast("array<struct<start:int,end:int>>"))
    return F.aggregate(counts, none, add, lambda s: F.when(s["i"] > s["start"], F.concat(s["done"], F.array(run(s["start"], s["i"])))).otherwise(s["done"]))


def sentence_boundary(texts: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """CHK-3: sentences packed up to ``size`` tokens; a chunk of several starts the next with its last two."""
    sentences = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    joined = lambda own, runs: F.transform(runs, lambda r: F.array_join(F.slice(own, r["start"] + 1, r["end"] - r["start"]), " "))
    pieces = let(sentences, lambda own: let(F.transform(own, lambda s: F.size(tokens(s))), lambda n: joined(own, packed(n, size, overlap))))
    own = texts.select("*", F.posexplode(pieces).alias("_i", "_piece"))
    return _chunk(own, id=F.concat("source_file", F.lit("_sent_"), F.col("_i").cast("string")), chunk_type=F.lit("sentence_boundary"), chunk_index=F.col("_i"), text=F.col("_piece"))


def parameters(texts: DataFrame) -> DataFrame:
    """CHK-4: parameter mentions with the text around them, numbered by family, then place."""
    text = F.coalesce("text", F.lit(""))
    around = lambda blocks, m: let(F.greatest(F.lit(0), m["start"] - CONTEXT), lambda a: cut(blocks, a, m["end"] + CONTEXT - a))
    named = lambda p, blocks: lambda m: F.struct(F.regexp_extract(m["match"], p, 1).alias("title"), F.regexp_extract(m["match"], p, 2).alias("value"), around(blocks, m).alias("text"))
    families = [_searched(p[1 : p.index(")")].split("|"), p) for p in PARAMETERS]
    found = lambda blocks: F.concat(*[F.transform(match_spans(text, p, ""), named(p, blocks)) for p in families])
    own = texts.select("*", F.posexplode(let(blocks_of(text), found)).alias("_i", "_m"))
    kind = F.lower(F.col("_m")["title"])
    more = F.create_map(F.lit("parameter_type"), kind, F.lit("parameter_value"), F.col("_m")["value"])
    meta = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("parameter_type", "parameter_value")), more)
    return _chunk(own, id=F.concat("source_file", F.lit("_param_"), F.col("_i").cast("string")), chunk_type=F.lit("parameter"), subsection=kind, text=F.col("_m")["text"], metadata=meta, chunk_index=F.col("_i"))


STRATEGIES = {"semantic": semantic, "sliding_window": sliding_window, "sentence_boundary": sentence_boundary, "parameter_extraction": parameters}


def chunked(texts: DataFrame, strategy: str = "semantic", **options) -> DataFrame:
    """CHK-7: chunks by the strategy of a name; an unknown name is an error."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    return STRATEGIES[strategy](texts, **options)


def with_uid(chunks: DataFrame) -> DataFrame:
    """Chunks with ``chunk_uid``, which tells apart those whose ids repeat."""
    n = F.row_number().over(Window.partitionBy("id").orderBy("section", "chunk_index", F.md5("text")))
    return chunks.withColumn("chunk_uid", F.concat("id", F.lit("#"), n.cast("string")))


def jsonl_records(chunks: DataFrame) -> DataFrame:
    """CHK-8: (text, metadata struct)."""
    meta = F.struct(F.col("source_file").alias("source"), "chunk_type", F.col("component_name").alias("component"), "manufacturer", "section")
    return chunks.select("text", meta.alias("metadata"))


def csv_rows(chunks: DataFrame) -> DataFrame:
    """CHK-9."""
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("component_name", "manufacturer", "section")]
    return chunks.select("id", "text", "chunk_type", "source_file", *blank, F.to_json("metadata").alias("metadata_json"))


def question_pairs(chunks: DataFrame) -> DataFrame:
    """CHK-10: (question, answer) for specification and application chunks."""
    name = F.when(F.coalesce("component_name", F.lit("")) == "", "this component").otherwise(F.col("component_name"))
    asked = F.when(F.col("chunk_type") == "specifications", F.concat(F.lit("What are the specifications for "), name, F.lit("?"))).when(F.col("chunk_type") == "application", F.concat(F.lit("What are the typical applications for "), name, F.lit("?")))
    return chunks.select(asked.alias("question"), F.col("text").alias("answer")).where("question is not null")


def corpus_summary(chunks: DataFrame) -> DataFrame:
    """CHK-11: (chunks, datasheets)."""
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("source_file").alias("datasheets"))
