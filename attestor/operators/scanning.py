"""Where the lines of a script begin: inside a quoted text, a comment, a tagged text, or plainly.

What a line begins in depends on all lines before it, so it cannot be read off the line. But each
line is a small map from states to states, and maps compose: lines are folded to the map of their
block, blocks to the map of their chapter, and the few chapters of a script are walked through in
order. Then the state at the beginning of each chapter, block and line follows downwards. No task
holds more than a block of lines or a chapter of blocks, and only marks travel, not the text.

A state is a text: empty for plain, ``'`` and ``e`` inside a quoted text without and with
backslash escapes, ``"`` inside a quoted name, ``--`` inside a line comment, ``/n`` inside ``n``
nested comments, and the tag itself inside a tagged text such as ``$body$``. A map lists the states
it changes otherwise than by keeping them, and by how much it changes deeper comments.

A script of no more lines than a block begins plainly and is one row, so it needs none of this: it
is cut as one text (``cut_scripts``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.session import written

LINES, BLOCKS = 12, 12  # bits of a line number that count within a block, and of a block within a chapter

TAG = r"\$(?:[A-Za-z_][A-Za-z_0-9]*+)?\$"
# marks in the order in which they are tried: an opening comment may follow a star at once
MARK = rf"""--|/\*|\*/\*|\*/|\\['\\]|(?<![A-Za-z0-9_])[eE]'|''|'|"|{TAG}|;"""

# what changes no state: text without marks, a doubled quote, an escaped backslash, two quotes of a name with no mark between
_NEUTRAL = r"""[^"'\\$;*/\-eE]++|[eE](?!')|''|\\\\|"[^"'\\$;*/\-]*+\""""

# whole constructs, each up to its end or that of the text; comments nest up to NESTED deep in a text
NESTED = 8
TEXT = r"'[^']*+(?:'|\z)"
ESCAPED_TEXT = r"(?<![A-Za-z0-9_])[eE]'(?:[^'\\]++|\\.|'')*+(?:'|\z)"
QUOTED_NAME = r'"[^"]*+(?:"|\z)'
TAGGED_TEXT = rf"(?<tag>{TAG}).*?(?:\k<tag>|\z)"
_INNER = r"[^*/]++|\*(?!/)|/(?!\*)"
COMMENT = rf"/\*(?:{_INNER})*+(?:\*/|\z)"
for _ in range(NESTED - 1):
    COMMENT = rf"/\*(?:{_INNER}|{COMMENT})*+(?:\*/|\z)"
# statement text goes on through quoted and tagged texts; comments are blanks
_UNMARKED = r"""[^;'"$/\-eE]++"""
_SEGMENT = rf"(?s){_UNMARKED}|{COMMENT}|--[^\n]*+|{ESCAPED_TEXT}|{TEXT}|{QUOTED_NAME}|{TAGGED_TEXT}|."
_PIECE = rf"(?s)((?:{_UNMARKED}|{ESCAPED_TEXT}|{TEXT}|{QUOTED_NAME}|{TAGGED_TEXT}|[^;])*+)(?:;|\z)"
# what goes on up to a statement end or a comment, and this, or the end; each find goes on where the one before ended. Without an
# E before a quote no text has backslash escapes, and letters need not be told apart
_TEXTS = rf"{TEXT}|{QUOTED_NAME}|{TAGGED_TEXT}|(?!;|--|/\*)."
_STOP = rf"(;|--[^\n]*+|{COMMENT}|\z)"
_UP_TO_STOP = rf"""(?s)\G((?:[^;'"$/\-]++|{_TEXTS})*+){_STOP}"""
_UP_TO_STOP_ESCAPED = rf"(?s)\G((?:{_UNMARKED}|[eE](?!')|{ESCAPED_TEXT}|{_TEXTS})*+){_STOP}"

# the state s after a mark t
_STEP = r"""
  CASE
    WHEN {s} = '' THEN CASE
      WHEN {t} IN ('''', '\\''') THEN '''' WHEN {t} IN ('e''', 'E''') THEN 'e' WHEN {t} = '"' THEN '"' WHEN {t} = '--' THEN '--'
      WHEN {t} IN ('/*', '*/*') THEN '/1' WHEN startswith({t}, '$') THEN {t} ELSE '' END
    WHEN {s} = '--' THEN IF({t} = '\n', '', {s})
    WHEN {s} = '''' THEN IF(endswith({t}, '''') AND {t} <> '''''', '', {s})
    WHEN {s} = 'e' THEN IF({t} IN ('''', 'e''', 'E'''), '', {s})
    WHEN {s} = '"' THEN IF({t} = '"', '', {s})
    WHEN startswith({s}, '$') THEN IF({t} = {s}, '', {s})
    WHEN {t} = '/*' THEN concat('/', CAST(substr({s}, 2) AS INT) + 1)
    WHEN {t} IN ('*/', '*/*') THEN IF({s} = '/1', '', concat('/', CAST(substr({s}, 2) AS INT) - 1))
    ELSE {s} END"""


def _fold(marks: str, state: str) -> str:
    """State and number of statement ends after an array of marks, from a state."""
    step = _STEP.format(s="a.st", t="t")
    # a semicolon changes no state, and is the mark that occurs most
    return (f"aggregate({marks}, named_struct('st', {state}, 'n', 0L), (a, t) -> IF(t = ';', "
            f"IF(a.st = '', named_struct('st', a.st, 'n', a.n + 1L), a), named_struct('st', {step}, 'n', a.n)))")


def _deepest(changes: str) -> str:
    """How many nested comments an array of (low, net) changes can close at most, and what it adds up to."""
    return (f"aggregate({changes}, named_struct('low', 0, 'net', 0), "
            "(a, c) -> named_struct('low', least(a.low, a.net + c.low), 'net', a.net + c.net))")


def _entries(marks: str) -> str:
    """The states that marks change: plain, quoted and tagged ones that a mark ends, and as many nested comments as are closed.

    A state that no mark ends is kept and no statement ends in it, so a map does not list it.
    """
    return f"""concat(IF(size({marks}) > 0, array(''), array()),
      IF(arrays_overlap({marks}, array('\\'', '\\\\\\'', 'e\\'', 'E\\'')), array('\\'', 'e'), array()),
      IF(array_contains({marks}, '"'), array('"'), array()), tags, {_nested("deep.low")})"""


def _nested(low: str) -> str:
    """As many nested comments as are closed."""
    return f"IF({low} < 0, transform(sequence(1, -({low})), k -> concat('/', k)), array())"


def _applied(m: str, state: str) -> str:
    """(state, number of statement ends) after a map, from a state."""
    other = f"IF(startswith({state}, '/'), concat('/', CAST(substr({state}, 2) AS INT) + {m}.net), {state})"
    return f"coalesce({m}.to[{state}], named_struct('st', {other}, 'n', 0L))"


def _walk(maps: str, first: str, n: str) -> str:
    """The states before each of an array of maps, and last the one after all of them, with running numbers of ends."""
    step = _applied("m", "element_at(a, -1).st")
    return (f"aggregate({maps}, array(named_struct('st', {first}, 'n', {n})), (a, m) -> concat(a, array("
            f"named_struct('st', {step}.st, 'n', element_at(a, -1).n + {step}.n))))")


def _by_number(items: str, number: str) -> str:
    """Items in the order of their numbers; maps themselves have no order."""
    return f"array_sort({items}, (l, r) -> CAST(sign(l.{number} - r.{number}) AS INT))"


def marks(line: Column) -> Column:
    """The marks of a line in order, and its end if a comment may end there; marks that change no state are left out."""
    found = F.array_remove(F.regexp_extract_all(line, F.lit(f"{_NEUTRAL}|({MARK})"), 1), "")
    # a comment that reaches the end of the line is looked for in the text, as the marks would be found twice otherwise
    return F.concat(found, F.when(F.contains(line, F.lit("--")), F.array(F.lit("\n"))).otherwise(F.array().cast("array<string>")))


def known_lines(lines: DataFrame) -> DataFrame:
    """(script_id, line_no, line): a null line is empty; a line without script or number is left out."""
    return lines.filter("script_id IS NOT NULL AND line_no IS NOT NULL").select(
        "script_id", "line_no", F.coalesce("line", F.lit("")).alias("line"))


def by_size(lines: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The lines of scripts that are no longer than a block, and those of longer ones if there are any.

    Only the scripts of the lines are read to tell them apart; a line without a number counts too, as either way is right.
    """
    known = known_lines(lines)
    counts = lines.filter("script_id IS NOT NULL").groupBy("script_id").agg(F.count("*").alias("_n"))
    long = written(counts.filter(F.col("_n") > (1 << LINES)).select("script_id"), "long-scripts")
    if long.isEmpty():
        return known, None
    return known.join(long, "script_id", "left_anti"), known.join(long, "script_id", "left_semi")


def cut_scripts(lines: DataFrame) -> DataFrame:
    """(script_id, pos, statement): the statements of scripts that are no longer than a block, each cut as one text.

    One shuffle of the lines brings a script together, and one pattern goes over its text once. Scripts
    whose line numbers come again, whose lines hold line ends, or whose comments nest deeper than NESTED,
    where the pattern stops short, are cut line by line.
    """
    scripts = lines.repartition("script_id").groupBy("script_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    scripts = scripts.withColumn("text", F.expr("array_join(lines.line, '\n')"))
    stops = "$1\x01$3\x01"  # 2 is a tag
    held = F.contains("text", F.lit("\x01")) | F.contains("text", F.lit("\x02")) | F.contains("text", F.lit("\x03"))
    text = F.when(held, _spelled(F.col("text"))).otherwise(F.col("text"))
    escaped = F.contains("text", F.lit("e'")) | F.contains("text", F.lit("E'"))
    scripts = scripts.withColumn("stops", F.when(escaped, F.regexp_replace(text, _UP_TO_STOP_ESCAPED, stops))
                                 .otherwise(F.regexp_replace(text, _UP_TO_STOP, stops)))
    scripts = scripts.withColumn("simple", F.expr(r"""
      size(array_distinct(lines.line_no)) = size(lines) AND length(text) - length(replace(text, '\n', '')) = size(lines) - 1
      AND endswith(stops, '\u0001')"""))
    # every other part is a stop: the end of a statement, or a comment, which is a blank on each of its lines
    parts = F.transform(F.split("stops", "\x01", -1), lambda x, i: F.when(i % 2 == 0, x).when(x == ";", "\x02").otherwise(_blank(x)))
    at_once = F.transform(F.split(F.array_join(parts, ""), "\x02", -1), lambda p, k: F.struct(
        k.alias("pos"), F.when(F.contains(p, F.lit("\x03")), _spelled(p, back=True)).otherwise(p).alias("statement")))
    # the others are cut like blocks; of a script that is cut at once, no more than an empty line is
    found = _found(scripts.withColumns({"lines": F.expr("IF(simple, array(struct(lines[0].line_no AS line_no, '' AS line)), lines)"), "st": F.lit(""), "n": F.lit(0).cast("long")}), "stops", "simple")
    by_line = F.expr("""transform(array_distinct(found.pos), p -> struct(p AS pos, array_join(transform(array_sort(transform(
      filter(found, x -> x.pos = p), x -> struct(x.line_no AS line_no, replace(x.piece, '\u0001\u0002', '\u0001') AS piece))), x -> x.piece), '\n') AS statement))""")
    return found.select("script_id", F.inline(F.when(F.col("simple"), at_once).otherwise(by_line)))


def _spelled(text: Column, back: bool = False) -> Column:
    """A text with the separators \\x01 and \\x02 spelled by other characters, or what was so spelled."""
    spelled = [("\x03", "\x03\x06"), ("\x01", "\x03\x04"), ("\x02", "\x03\x05")]
    for old, new in spelled[::-1] if back else spelled:
        text = F.replace(text, F.lit(new if back else old), F.lit(old if back else new))
    return text


def _blank(comment: Column) -> Column:
    """What is left of a comment: a blank on each of its lines."""
    ends = F.length(comment) - F.length(F.replace(comment, F.lit("\n"), F.lit("")))
    return F.when(comment == "", "").otherwise(F.concat(F.repeat(F.lit(" \n"), ends), F.lit(" ")))


def blocks_with_states(lines: DataFrame) -> DataFrame:
    """(script_id, block, lines, st, n): the lines of each block in order, what the block begins in, how many statements end before it.

    Lines are (script_id, line_no, line); numbers ascend and may have gaps. A null line is empty; a
    line without script or number is left out. Blocks and their maps are written once.
    """
    known = known_lines(lines).withColumn("block", F.shiftright("line_no", LINES))
    blocks = known.groupBy("script_id", "block").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    # the map of a block: its marks are folded from every state that they change
    blocks = (blocks.withColumn("all", F.flatten(F.transform("lines", lambda x: marks(x["line"]))))
              .withColumn("tags", F.expr("array_distinct(filter(all, t -> startswith(t, '$')))"))
              .withColumn("deep", F.expr("IF(array_contains(all, '*/') OR array_contains(all, '*/*') OR array_contains(all, '/*'), " + _deepest(
                  "transform(all, t -> named_struct('low', IF(t IN ('*/', '*/*'), -1, 0), 'net', CASE WHEN t = '/*' THEN 1 WHEN t IN ('*/', '*/*') THEN -1 ELSE 0 END))")
                  + ", named_struct('low', 0, 'net', 0))")))
    blocks = written(blocks.select("script_id", "block", "lines", F.expr(
        f"named_struct('to', map_from_entries(transform({_entries('all')}, s -> struct(s, {_fold('all', 's')}))), "
        "'tags', tags, 'low', deep.low, 'net', deep.net)").alias("map")), "script-blocks")
    maps = blocks.select("script_id", F.shiftright("block", BLOCKS).alias("chapter"), "block", "map")
    chapters = (maps.groupBy("script_id", "chapter").agg(F.collect_list(F.struct("block", "map")).alias("b"))
                .withColumn("b", F.expr(_by_number("b", "block")))
                .selectExpr("script_id", "chapter", "b.block AS blocks", "b.map AS maps"))
    tags = "array_distinct(flatten(transform(maps, m -> m.tags)))"
    deep = _deepest("transform(maps, m -> named_struct('low', m.low, 'net', m.net))")
    composed = (f"aggregate(maps, named_struct('st', s, 'n', 0L), (a, m) -> transform(array({_applied('m', 'a.st')}), "
                "f -> named_struct('st', f.st, 'n', a.n + f.n))[0])")
    states = f"""concat(array('', '\\'', 'e', '"'), tags, {_nested("deep.low")})"""
    whole = (chapters.withColumn("tags", F.expr(tags)).withColumn("deep", F.expr(deep))
             .select("script_id", "chapter", F.expr(
                 f"named_struct('to', map_from_entries(transform({states}, s -> struct(s, {composed}))), "
                 "'tags', tags, 'low', deep.low, 'net', deep.net)").alias("map")))
    begun = (whole.groupBy("script_id").agg(F.collect_list(F.struct("chapter", "map")).alias("c"))
             .withColumn("c", F.expr(_by_number("c", "chapter")))
             .withColumn("at", F.expr(_walk("transform(c, x -> x.map)", "''", "0L")))
             .select("script_id", F.expr("inline(zip_with(c, slice(at, 1, size(c)), (x, y) -> struct(x.chapter AS chapter, y.st AS st, y.n AS n)))")))
    of_blocks = (chapters.join(begun, ["script_id", "chapter"]).withColumn("at", F.expr(_walk("maps", "st", "n")))
                 .select("script_id", F.expr("inline(zip_with(blocks, slice(at, 1, size(blocks)), (x, y) -> struct(x AS block, y.st AS st, y.n AS n)))")))
    return blocks.select("script_id", "block", "lines").join(of_blocks, ["script_id", "block"])


def cut_blocks(blocks: DataFrame) -> DataFrame:
    """(script_id, pos, line_no, piece): what each block of ``blocks_with_states`` holds of each statement, without comments.

    The pieces of a statement meet inside their block first, so that one row a block and statement
    is left. Where a line number comes again, each of its lines is cut from each of their states.
    """
    return (_found(blocks).select("script_id", F.inline("found"))
            .withColumn("piece", F.replace("piece", F.lit("\x01\x02"), F.lit("\x01"))))


def _found(blocks: DataFrame, *more: str) -> DataFrame:
    """Blocks with the array of what they hold of each statement, and more of their columns."""
    blocks = blocks.withColumn("marks", F.transform("lines", lambda x: marks(x["line"])))
    blocks = blocks.withColumn("at", F.expr(
        "aggregate(marks, array(named_struct('st', st, 'n', n)), (a, l) -> concat(a, array(IF(size(l) = 0, element_at(a, -1), transform(array("
        + _fold("l", "element_at(a, -1).st") + "), f -> named_struct('st', f.st, 'n', element_at(a, -1).n + f.n))[0]))))"))
    begun = "struct({x}.line_no AS line_no, {x}.line AS line, at[i].st AS state, at[i].n AS first, at[i + 1].n - at[i].n AS ends)"
    every = "sequence(0, size(lines) - 1)"
    blocks = blocks.withColumn("again", F.expr("size(array_distinct(lines.line_no)) < size(lines)")).withColumn("begun", F.expr(
        f"IF(again, flatten(transform({every}, i -> transform(filter(lines, x -> x.line_no = lines[i].line_no), x -> {begun.format(x='x')}))), "
        f"transform({every}, i -> {begun.format(x='lines[i]')}))"))
    cut = blocks.select("script_id", "lines", "n", "again", *more, F.transform("begun", lambda x: F.struct(
        x["line_no"].alias("line_no"), x["first"].alias("first"), x["ends"].alias("ends"),
        F.transform(pieces(x["line"], x["state"], x["ends"]), lambda p: F.replace(p, F.lit("\x01"), F.lit("\x01\x02"))).alias("pieces"))).alias("cut"))
    # a separator that no piece holds stands between the statements of a line, a line end between lines
    joined = """array_join(transform(cut, x -> concat(array_join(x.pieces, '\\u0001\\u0003'),
      repeat('\\u0001\\u0003', CAST(x.ends AS INT) + 1 - size(x.pieces)))), '\\n')"""
    found = F.expr(f"""IF(again,
      flatten(transform(cut, x -> transform(x.pieces, (p, k) -> struct(CAST(x.first + k AS INT) AS pos, x.line_no AS line_no, p AS piece)))),
      transform(split({joined}, '\\u0001\\u0003', -1), (p, k) -> struct(CAST(n + k AS INT) AS pos, lines[0].line_no AS line_no, p AS piece)))""")
    return cut.select("script_id", *more, found.alias("found"))


def pieces(line: Column, state: Column, ends: Column) -> Column:
    """What a line holds of each statement, without comments: one piece more than statements that end in it."""
    nested = F.repeat(F.lit("/*"), F.substring(state, 2, 9).try_cast("int"))
    opening = F.when(F.startswith(state, F.lit("/")), nested).when(state == "e", "e'").otherwise(state)
    opened = F.concat(opening, line)
    segments = F.regexp_extract_all(opened, F.lit(f"({_SEGMENT})"), 1)
    plain = F.when(F.contains(opened, F.lit("--")) | F.contains(opened, F.lit("/*")), F.array_join(F.transform(segments, lambda x: F.when(
        F.startswith(x, F.lit("--")) | F.startswith(x, F.lit("/*")), F.lit(" ")).otherwise(x)), "")).otherwise(opened)
    cut = F.slice(F.regexp_extract_all(plain, F.lit(_PIECE), 1), 1, ends.cast("int") + 1)
    # what was put in front of the line to say how it begins goes again, unless it went with a comment
    lead = F.when(F.startswith(state, F.lit("/")), 0).otherwise(F.length(opening))
    return F.transform(cut, lambda x, i: F.when(i == 0, F.substr(x, lead + 1)).otherwise(x))
