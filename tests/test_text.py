"""Column functions on text, on the cases that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from attestor import fixed
from attestor.functions import diagram, names, text
from attestor.operators import lines, mentions, types


def one(spark, function, value):
    return spark.createDataFrame([(value,)], "c string").select(function(F.col("c")).alias("v")).collect()[0].v


@pytest.mark.parametrize("function,given,expected", [
    (text.fix_negative_defaults, "score int default  -1,", "score int DEFAULT '-1',"),
    (text.fix_uuid, "DEFAULT gen_random_uuid()", "DEFAULT `uuid_generate_v4()`"),
    (text.alias_types, "a TIMESTAMP WITH TIME ZONE, b character varying(9)", "a timestamptz, b varchar(9)"),
    (text.alias_types, "mytime with time zone x", "mytime with time zone x"),
    (text.quote_arrays, "tags text[], größe int[]", 'tags "text []", größe "int []"'),
    (text.strip_spans, "a $$ x\ny $$ b $$z$$", "a  b "),
    (text.strip_spans, "x CREATE OR REPLACE FUNCTION f() AS\n1; y", "x  y"),
    (text.strip_spans, "a CHECK (length(b) > 1), c CHECK (d > 0)", "a , c CHECK (d > 0)"),
    (text.normalize_space, "select 1;\n  create   table t", "select 1;\ncreate table t"),
    (text.space_settings, "Table users[color: red]", "Table users [color: red]"),
    (text.terminate_line, "CREATE INDEX i ON t (a) WHERE b", "CREATE INDEX i ON t (a) WHERE b;"),
    (text.terminate_line, "CREATE TABLE t (a int)", "CREATE TABLE t (a int)"),
    (text.squeeze, "a  \n \n\n\nb\t", "a\n\nb"),
    (names.base_type, "numeric(10,2)[]", "numeric"),
    (names.type_parameters, "numeric(10,2)", "10,2"),
    (names.type_parameters, "text", None),
    (diagram.quote_identifier, "order", '"order"'), (diagram.quote_identifier, "_x", '"_x"'),
    (diagram.quote_identifier, '"done"', '"done"'), (diagram.quote_identifier, 'a"b', '"a\\"b"'),
    (diagram.quote_identifier, "", ""),
    (diagram.format_default, "'a'::text", "'a'"), (diagram.format_default, "-3", "'-3'"),
    (diagram.format_default, "3.5", "3.5"), (diagram.format_default, ".", "'.'"), (diagram.format_default, "", "''"),
    (diagram.format_default, None, "''"), (diagram.format_default, "2024-01-01", "2024-01-01"),
    (diagram.table_alias, "short", None), (diagram.table_alias, "order_audit_log_entry", "OALE"), (diagram.table_alias, "order_audit_log_entry_9", "ORDE"),
    (diagram.table_alias, "customer_billing_address", "CBA"), (diagram.table_alias, "a" * 30, "AAAA"),
    (diagram.clean_index_column, "lower(name)", "name"), (diagram.clean_index_column, "data -> 'k'", None),
    (diagram.clean_index_column, "a DESC NULLS LAST", "a"),
])
def test_function(spark, function, given, expected):
    assert one(spark, function, given) == expected


def test_first_matching_rule_names_a_removed_line(spark):
    df = spark.createDataFrame([(1, n, t) for n, t in enumerate([
        "\\.", "set x = 1;", "-- SET", "", "REVOKE ALL", "x OWNER TO y", "ALTER TABLE ONLY a SET DEFAULT 1", "SETTLE x"])],
        "script_id long, line_no long, line string")
    found = [r.statement_type for r in lines.classify_lines(df).orderBy("line_no").collect()]
    assert found == ["PSQL_COMMAND", "SET", None, None, "PERMISSION", "OWNERSHIP", "COLUMN_DEFAULT", None]


def test_repair_looks_ahead_without_taking_the_next_character(spark):
    df = spark.createDataFrame([(1, "a[]b[]x c[] [default: -1]\n [x] Table t[y]")], "doc long, text string")
    found = lines.repair_docs(df).collect()[0]
    assert found.text == '"a []""b []"x c[] [default: \'-1\'] [x] Table t [y]'
    assert found.fixes == ["TABLE_SETTINGS_SPACING", "NEGATIVE_DEFAULTS", "ARRAY_TYPE_QUOTING", "BRACKET_LINE_BREAKS"]


def statements(spark, *texts):
    rows = [(n, i, line) for n, t in enumerate(texts) for i, line in enumerate(t.split("\n"))]
    return mentions.statements(spark.createDataFrame(rows, "script_id long, line_no long, line string"))


def test_table_mentions(spark):
    found = mentions.extract_tables(statements(
        spark, 'CREATE TABLE IF NOT EXISTS public.a (x int);\ncreate table "b""c" (y int); CREATE TABLE a (z int);\nCREATE TABLE public."Order" (\n n int\n);'))
    assert [r.table_name for r in found.orderBy("pos").collect()] == ["a", 'b"c', "a", "Order"]
    first = {r.table_name: r.pos for r in mentions.first_definition(found).collect()}
    assert first == {"a": 0, 'b"c': 1, "Order": 3}


def test_statements_end_outside_quotes(spark):
    text = ("a 'x;y' b; ;c\nd 'it''s;\nstill; in' e;\nf $$ body; 'open\n more; $$ g; h 'q;' i\n;last")
    found = statements(spark, text, "", "one;two").orderBy("script_id", "pos").collect()
    assert [(r.script_id, r.pos, r.statement) for r in found] == [
        (0, 0, "a 'x;y' b"), (0, 2, "c\nd 'it''s;\nstill; in' e"), (0, 3, "f $$ body; 'open\n more; $$ g"), (0, 4, "h 'q;' i"), (0, 5, "last"),
        (2, 0, "one"), (2, 1, "two")]


def test_every_clause_and_nested_expressions(spark):
    s = statements(spark, """CREATE INDEX "I x" ON public."Order" USING GIN (lower(a), b DESC, coalesce(f(c), d));
ALTER TABLE ONLY public."Order" ADD COLUMN p numeric(10,2) DEFAULT 1, ADD COLUMN q text;
ALTER TABLE t ADD CONSTRAINT k UNIQUE (a, b), ADD CONSTRAINT "F" FOREIGN KEY (a) REFERENCES public."Order" ("Id") ON DELETE SET NULL;
CREATE TYPE m AS ENUM ('a)', 'it''s'); CREATE TYPE n AS ENUM (none); CREATE INDEX broken (a)""")
    index = mentions.extract_indexes(s).first()
    assert (index.index_name, index.table_name, index.columns, index.index_method) == ("I x", "Order", ["lower(a)", "b DESC", "coalesce(f(c), d)"], "gin")
    assert [(r.table_name, r.column_name, r.data_type) for r in mentions.added_columns(s).orderBy("clause_no").collect()] == [
        ("Order", "p", "numeric(10,2)"), ("Order", "q", "text")]
    assert [(r.constraint_name, r.constraint_type, r.columns) for r in mentions.added_constraints(s).orderBy("constraint_type").collect()] == [
        ("F", "f", ["a"]), ("k", "u", ["a", "b"])]
    key = mentions.extract_fks(mentions.added_constraints(s)).first()
    assert (key.target_table, key.target_columns, key.on_delete, key.on_update) == ("Order", ["Id"], "SET NULL", None)
    assert [r["values"] for r in mentions.extract_enums(s).collect()] == [["a)", "it's"]]
    assert sorted(r.context for r in mentions.extract_errors(s).collect()) == ["CREATE ENUM parsing failed", "CREATE INDEX parsing failed"]


def test_column_attributes(spark):
    df = spark.createDataFrame([("email varchar(255) NOT NULL UNIQUE DEFAULT 'x',",), ('"Odd name" int primary key',), ("lonely",)],
                               "definition string")
    found = {r.column_name: r for r in mentions.column_attributes(df).collect()}
    assert set(found) == {"email", "Odd name"}
    assert found["email"].data_type == "varchar(255)" and found["email"].default_value == "'x'" and not found["email"].is_nullable
    assert found["Odd name"].is_primary_key and found["Odd name"].data_type == "int"


@pytest.mark.parametrize("given,new,rule", [
    ("Mood", "Mood", "enum"), ("mood[]", '"mood[]"', "array"), ("integer[]", '"int4[]"', "array"),
    ("numeric(10,2)[]", '"numeric(10,2)[]"', "array"), ("decimal(5,1)", "numeric(5,1)", "known"),
    ("char(3)", "bpchar", "known"), ("VARCHAR(9)", "varchar(9)", "known"), ("tstzmultirange", "text", "fallback"),
    ("int4multirange", "text", "known")])
def test_type_mapping(spark, given, new, rule):
    columns = spark.createDataFrame([(1, "t", "c", given)], "schema_id long, table_name string, column_name string, data_type string")
    enums = spark.createDataFrame([(1, "mood")], "schema_id long, enum_name string")
    found = types.map_types(columns, enums).collect()[0]
    assert (found.new_type, found.type_rule) == (new, rule)


def test_array_fallback_warns(spark):
    columns = spark.createDataFrame([(1, "t", "c", "text[]")], "schema_id long, table_name string, column_name string, data_type string")
    mapped = types.map_types(columns, strategy="text_fallback")
    assert mapped.collect()[0].new_type == "text"
    assert types.type_warnings(mapped, "text_fallback").count() == 1
    assert types.type_warnings(types.map_types(columns)).count() == 0


def test_cast_failures(spark):
    df = spark.createDataFrame([("1", "{}", "true"), ("x", "{", None), (None, None, "maybe")], "a string, b string, c string")
    found = {r.column_name: (r.n_values, r.n_failed) for r in types.cast_failures(df, {"a": "int4", "b": "jsonb", "c": "bool"}).collect()}
    assert found == {"a": (2, 1), "b": (2, 1), "c": (2, 1)}


def test_words_that_a_text_lacks_are_not_looked_for_by_pattern(spark):
    texts = ["a create b  ALTER x;Drop\ty", "create create  CREATE z", "xinsert y updated delete", "nothing", "", None, "ſelect ı İNSERT  x İ delete \u2003 y"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    plain = F.regexp_replace("c", r"\s+", " ")
    for word in fixed.STATEMENT_WORDS:
        plain = F.regexp_replace(plain, rf"(?i)(\S)\s*({word}\s+)", "$1\n$2")
    assert [a for a, b in df.select(text.normalize_space(F.col("c")), plain).collect()] == [r[0] for r in df.select(plain).collect()]
    shown = df.select(text.normalize_space(F.col("c")))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert all("contains(upper(lambda x" in shown and f", {word.lower()})" in shown for word in fixed.STATEMENT_WORDS)
