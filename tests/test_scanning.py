"""Cutting scripts into statements and table bodies into items."""

import random
import re

import pytest

from attestor import session
from attestor.operators import mentions, scanning
from tests.test_text import statements

SCRIPT = r"""-- it's a comment; one
CREATE TABLE a (x int); SELECT 'a;
b''c;'; SELECT E'it\'s; ' ; /* outer ; /* inner ' */ still
' ; CREATE TABLE hidden (x int); */ CREATE TABLE b (y /* ; */ int); DO $body$ ; '
 CREATE TABLE inner (z int); $$ ; " -- $body$; SELECT "na;me", $$ a
b ; $$; SELECT '', ''';', 1 -- end; '
"""


@pytest.mark.parametrize("bits", [(12, 12), (1, 1), (0, 1)])
def test_comments_tags_and_quotes_over_lines(spark, monkeypatch, bits):
    monkeypatch.setattr(scanning, "LINES", bits[0])
    monkeypatch.setattr(scanning, "BLOCKS", bits[1])
    found = statements(spark, SCRIPT, "", "-- a; b").orderBy("script_id", "pos").collect()
    assert [r.statement for r in found] == [
        "CREATE TABLE a (x int)", "SELECT 'a;\nb''c;'", r"SELECT E'it\'s; '", "CREATE TABLE b (y   int)",
        "DO $body$ ; '\n CREATE TABLE inner (z int); $$ ; \" -- $body$", 'SELECT "na;me", $$ a\nb ; $$', "SELECT '', ''';', 1"]
    tables = mentions.extract_tables(statements(spark, SCRIPT))
    assert sorted(r.table_name for r in tables.collect()) == ["a", "b"]
    kinds = {r.kind: r.n_statements for r in mentions.statement_kinds(statements(spark, SCRIPT)).collect()}
    assert kinds == {"CREATE TABLE": 2, "OTHER": 5}


def test_pieces_meet_in_their_block(spark):
    lines = spark.createDataFrame(
        [(1, 1, "a '"), (1, 2, "b\x01\x03;\x01"), (1, 3, "' /* ;"), (1, 4, "*/ c; d"), (1, 5000, "e"), (2, 7, "x;"), (2, 7, "x;"), (None, 1, "n"), (3, None, "n")],
        "script_id long, line_no long, line string")
    blocks = scanning.blocks_with_states(lines)
    assert "ExistingRDD" not in blocks._jdf.queryExecution().executedPlan().toString()  # the lines are read and shuffled once
    rows = scanning.cut_blocks(blocks.filter("script_id = 1")).collect()
    assert sorted((r.pos, r.line_no) for r in rows) == [(0, 1), (1, 1), (1, 5000)]  # one row a block and statement, not a line
    found = mentions.statements(lines).orderBy("script_id", "pos").collect()
    assert [(r.script_id, r.pos, r.statement) for r in found] == [
        (1, 0, "a '\nb\x01\x03;\x01\n'  \n  c"), (1, 1, "d\ne"), (2, 0, "x\nx"), (2, 1, "x\nx")]


def cut_by_hand(text):
    """Statements of a text, read character by character, without blanks."""
    out, now, at, state, depth = [], "", 0, "", 0
    while at < len(text):
        two, c, step = text[at:at + 2], text[at], 1
        tag = re.match(r"\$(?:[A-Za-z_]\w*)?\$", text[at:], re.A)
        if state == "--":
            state = "" if c == "\n" else state
            c = ""
        elif state == "/*":
            step = 2 if two in ("/*", "*/") else 1
            depth += {"/*": 1, "*/": -1}.get(two, 0)
            state = state if depth else ""
            c = ""
        elif state in ("'", '"'):
            state = "" if c == state else state
        elif state:
            if tag and tag[0] == state:
                c, step, state = state, len(state), ""
        elif two == "--":
            c, step, state = "", 2, "--"
        elif two == "/*":
            c, step, state, depth = "", 2, "/*", 1
        elif tag:
            c, step, state = tag[0], len(tag[0]), tag[0]
        elif c in ("'", '"'):
            state = c
        elif c == ";":
            out.append(now)
            now, c = "", ""
        now, at = now + c, at + step
    return [re.sub(r"\s+", "", s) for s in [*out, now] if s.strip()]


def test_cutting_agrees_with_reading_characters(spark, monkeypatch):
    monkeypatch.setattr(scanning, "LINES", 1)
    monkeypatch.setattr(scanning, "BLOCKS", 2)
    draw = random.Random(8)
    parts = ["a", "b ", "'", '"', ";", "\n", "--", "/* ", "*/ ", "$$ ", "$t$ ", " x", "''", "\n", "*", "/ "]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 45))) for _ in range(500)]
    found = {}
    for r in statements(spark, *texts).orderBy("script_id", "pos").collect():
        found.setdefault(r.script_id, []).append(re.sub(r"\s+", "", r.statement))
    wrong = [t for n, t in enumerate(texts) if found.get(n, []) != cut_by_hand(t)]
    assert not wrong, (wrong[0], found.get(texts.index(wrong[0])), cut_by_hand(wrong[0]))


def test_short_scripts_are_cut_at_once_and_long_ones_by_blocks(spark, monkeypatch):
    deep = "/* " * 12 + "x;\n" + "*/ " * 12 + "a; b"
    texts = [SCRIPT, deep, "a /* one\n\ntwo */ b; c", "a -- b", "x;\n" * 9 + "'y;\n z'"]
    rows = [(n, k, line) for n, text in enumerate(texts) for k, line in enumerate(text.split("\n"))]
    rows += [(7, 1, "a;b"), (7, 1, "c;d"), (8, 1, "a -- x;\nb;"), (8, 2, "c")]
    lines = spark.createDataFrame(rows, "script_id long, line_no long, line string")
    before = len(session._scratch)
    short = mentions.statements(lines)
    assert not [path for path in session._scratch[before:] if "script-blocks" in path]
    text = short._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "pos#" not in text.split("Exchange hashpartitioning")[1]
    monkeypatch.setattr(scanning, "by_size", lambda lines: (scanning.known_lines(lines).filter("false"), scanning.known_lines(lines)))
    blocks = mentions.statements(lines)  # every script goes by blocks
    monkeypatch.undo()
    monkeypatch.setattr(scanning, "LINES", 3)  # the last text is longer, the others go at once
    before, both = len(session._scratch), mentions.statements(lines)
    assert [path for path in session._scratch[before:] if "script-blocks" in path]
    expected = sorted(blocks.collect())
    assert sorted(short.collect()) == expected and sorted(both.collect()) == expected
    assert [r.statement for r in expected if r.script_id == 2] == ["a  \n \n  b", "c"]


def test_one_pattern_cuts_a_short_script(spark):
    lines = spark.createDataFrame([(1, 1, "a '\x01;\x02' \x03\x04; E'x\\'; \x01' /* ;"), (1, 2, "; */ -- ;"), (1, 3, "b;")], "script_id long, line_no long, line string")
    found = scanning.cut_scripts(lines)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(" in text and "regexp_extract_all(text" not in text  # the text is gone over once
    assert [(r.pos, r.statement) for r in found.collect() if r.statement] == [(0, "a '\x01;\x02' \x03\x04"), (1, " E'x\\'; \x01'  \n   \nb")]


def test_bodies_are_cut_where_they_stand(spark):
    deep = "(" * 11 + "a, 'b)'" + ")" * 11
    rows = [(1, 0, f"CREATE TABLE t (a {deep}, b numeric(1, 2),, c e'\\'(') x (y)"), (1, 1, "CREATE TABLE u (a (b, c"), (1, 2, "CREATE TABLE v (a, E'b, 'c), d \\")]
    tables = mentions.extract_tables(spark.createDataFrame(rows, "script_id long, pos int, statement string"))
    found = mentions.body_items(tables)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # no piece is shuffled
    assert sorted((r.pos, r.item_no, r.definition) for r in found.collect()) == [
        (0, 0, f"a {deep}"), (0, 1, "b numeric(1, 2)"), (0, 3, "c e'\\'('"), (1, 0, "a (b, c"), (2, 0, "a"), (2, 1, "E'b, 'c")]


BODY = """CREATE TABLE public.users (
    id integer NOT NULL DEFAULT nextval('users_id_seq'::regclass), -- key; it's one
    "full ""name" varchar(255) DEFAULT 'a, (b' UNIQUE,
    price numeric(10, 2) NOT NULL DEFAULT (1 + (2 * (3 + (4)))),
    tags text[] DEFAULT '{}'::text[],
    note text CHECK (note <> ') NOT NULL'),
    CONSTRAINT users_pkey PRIMARY KEY (id),
    CONSTRAINT deep CHECK ((((price > 0) AND (length(note) < 5)) OR (price IS NULL))),
    FOREIGN KEY (id) REFERENCES public.people (id) ON DELETE CASCADE,
    UNIQUE ("full ""name", price), EXCLUDE USING gist (price WITH =)
) WITH (fillfactor = 70, x = 1);
CREATE TABLE part PARTITION OF users FOR VALUES IN (1, 2); CREATE TABLE copied AS SELECT f(a, b) FROM t;
CREATE TABLE kid (extra int) INHERITS (users)"""


def test_bodies_of_tables(spark):
    tables = mentions.extract_tables(statements(spark, BODY))
    columns = mentions.body_columns(tables).orderBy("pos", "item_no").collect()
    assert [(r.table_name, r.item_no, r.column_name, r.data_type, r.default_value, r.is_nullable, r.is_unique) for r in columns] == [
        ("users", 0, "id", "integer", "nextval('users_id_seq'::regclass)", False, False),
        ("users", 1, 'full "name', "varchar(255)", "'a, (b'", True, True),
        ("users", 2, "price", "numeric(10, 2)", "(1 + (2 * (3 + (4))))", False, False),
        ("users", 3, "tags", "text[]", "'{}'::text[]", True, False), ("users", 4, "note", "text", None, True, False),
        ("kid", 0, "extra", "int", None, True, False)]
    keys = mentions.body_constraints(tables).orderBy("pos", "item_no").collect()
    assert [(r.item_no, r.constraint_name, r.constraint_type, r.columns) for r in keys] == [
        (5, "users_pkey", "p", ["id"]), (6, "deep", "c", []), (7, None, "f", ["id"]), (8, None, "u", ['full "name', "price"])]
