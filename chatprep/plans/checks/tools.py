"""Tool use from JSON lines to rendered text."""

from pyspark.sql import functions as F

from chatprep.operators import templates as R
from chatprep.operators.turns import valid_prefix
from chatprep.plans import standins as S
from chatprep.plans.catalog import query
from chatprep.sources import jsonl as J

QWEN = R.get_template("qwen")

# One line per document: a question, a call, the tool's reply and an answer; every third call
# has its arguments as text, every fifth line a broken call, every seventh no tools.


def tool_lines(t):
    d = F.col("doc_id").cast("string")
    calls = (
        F.when(F.col("doc_id") % 5 == 0, F.lit('[{"id":"c1","type":"function","function":{"name":"f","arguments":"{broken"}},7]'))
        .when(F.col("doc_id") % 3 == 0, F.concat(F.lit('[{"id":"c","function":{"name":"find","arguments":"{\\"x\\":'), d, F.lit('}"}}]')))
        .otherwise(F.concat(F.lit('[{"id":"c","type":"function","function":{"name":"find","arguments":{"x":'), d, F.lit("}}},{\"type\":\"other\"}]")))
    )
    said = F.to_json(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    line = F.concat(
        F.lit('{"id":"'), d, F.lit('","effort":"high","limit":'), d, F.lit(',"none":null,"conversations":['), said,
        F.lit(',{"role":"assistant","content":"'), F.when(F.col("doc_id") % 2 == 0, "let me see").otherwise(""), F.lit('","tool_calls":'), calls,
        F.lit('},{"role":"tool","content":"found '), d, F.lit('"},{"role":"assistant","content":"done"}]'),
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(',"tools":[{"name":"find"}]'), F.lit("}"),
    )
    return J.good_lines(J.parse_lines(t.documents.select(line.alias("value"))))


@query(
    """SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 5 = 0 THEN 'c1/function/f/{}'
  WHEN doc_id % 3 = 0 THEN 'c/function/find/{"x":' || doc_id || '}'
  ELSE 'c/function/find/{"x":' || doc_id || '}|/other//{}' END AS calls FROM documents"""
)
def clean_tool_calls(t):
    calls = J.clean_tool_calls(F.get("conversations", F.lit(1))["tool_calls"])

    def flat(c):
        return F.concat_ws("/", c["id"], c["type"], c["function"]["name"], c["function"]["arguments"])

    return tool_lines(t).select("id", F.array_join(F.transform(calls, flat), "|").alias("calls"))


@query("""SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 7 = 0 THEN '[]' ELSE '[{"name":"find"}]' END AS tools FROM documents""")
def parsed_tools(t):
    return tool_lines(t).select("id", F.to_json(J.parse_tools(F.col("tools"))).alias("tools"))


@query("SELECT doc_id::VARCHAR AS id, 'effort=high,limit=' || doc_id AS options FROM documents")
def render_options(t):
    rows = J.render_options(tool_lines(t), ["effort", "limit", "none", "absent"])
    pairs = F.array_sort(F.transform(F.map_entries("render_options"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.select("id", F.array_join(pairs, ",").alias("options"))


def _call_sql(name: str, arguments: str) -> str:
    return f"""'<tool_call>' || chr(10) || '{{"name":"{name}","arguments":' || {arguments} || '}}' || chr(10) || '</tool_call>'"""


_ARGUMENTS = """('{"x":' || doc_id || '}')"""
_REPLY_SQL = f"""CASE WHEN doc_id % 2 = 0 THEN 'let me see' || chr(10) ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN {_call_sql("f", "'{}'")}
  WHEN doc_id % 3 = 0 THEN {_call_sql("find", _ARGUMENTS)} ELSE {_call_sql("find", _ARGUMENTS)} END"""
_PARTS = " || ".join(
    S.sql_render(f"'{role}'", f"({text})", QWEN)
    for role, text in (("user", "text"), ("assistant", _REPLY_SQL), ("tool", "'found ' || doc_id"), ("assistant", "'done'"))
)


@query(f"SELECT doc_id::VARCHAR AS id, {_PARTS} AS text FROM documents")
def render_tool_use(t):
    rows = tool_lines(t).withColumn("messages", valid_prefix(J.sanitise_messages(F.col("conversations"))))
    text = R.render_conversation(F.lit(None).cast("string"), F.col("messages"), QWEN, tools=True)
    return rows.select("id", text.alias("text"))
