"""An event log and a release log derived from ``conversations``.

session = conv_id div 4; conv_id % 4 = 0 is the main thread, the others are subagents.
Sequence numbers are a formula of (turn, conv_id, part), so no window is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cloakstone.operators.approval import RELEASE_TOOL

CALL = "array<struct<id:string,source_event_id:string,function:struct<name:string,arguments:string>>>"
FIELDS = {
    "seq": "bigint", "id": "string", "type": "string", "thread_id": "string", "content_text": "string",
    "content_kind": "string", "reasoning_content": "string", "tool_calls": CALL, "turn_id": "string",
    "sandbox_id": "string", "approval": "struct<status:string,reason:string>",
}


def _event(**given: str) -> str:
    parts = (f"'{name}', CAST({given.get(name, 'NULL')} AS {kind})" for name, kind in FIELDS.items())
    return f"named_struct({', '.join(parts)})"


def _call(call_id: str, source: str, tool: str, arguments: str) -> str:
    return (
        f"array(named_struct('id', {call_id}, 'source_event_id', {source}, "
        f"'function', named_struct('name', {tool}, 'arguments', {arguments})))"
    )


# A verifier's output: sound on lane 0 and 3, of an old run on lane 1, malformed on lane 2.
_PAYLOAD = (
    """concat('{"check":"scrub","schema_version":1,"run_id":"', if(lane = 1, 'run-old', concat('run-', sid)), """
    """'","passed":true,"row_count":', if(lane = 2, '"many"', string(turn)), """
    """',"columns":["arm"],"surviving_identifier_columns":[],"canary_present":null}')"""
)
# Every 13th conversation's commands print identifiers of a trial row.
_LEAK = (
    "if(conv_id % 13 = 5, concat('\\nrow STUDY-', lpad(string(conv_id), 7, '0'), ' p', string(conv_id), "
    "'@example.com end'), '')"
)
_BODY = (
    """if((conv_id + turn) % 30 = 0, '{"success":false}', to_json(named_struct('success', true, 'response', """
    f"named_struct('exitCode', if((conv_id + turn) % 10 = 0, 1, 0), 'result', concat('log ok\\n', {_PAYLOAD}, '\\n', text, {_LEAK})))))"
)


def _message_events() -> list[str]:
    """Events of one conversation row, each null where the row has none of its kind."""
    message = {"id": "message", "thread_id": "thread", "content_kind": "'text'"}
    base = _event(
        **{**message, "content_kind": "if(conv_id % 6 = 2, 'parts', 'text')"},
        seq="pos + if(swapped, 5, 4)", type="'model.message'", content_text="substring(text, 1, half)",
        reasoning_content="if(conv_id % 7 = 0, concat('weighing turn ', string(turn)), NULL)",
        tool_calls="if(conv_id % 5 = 0, "
        + _call("concat('c-', message)", "NULL", "'run_python'", """concat('{"code":"step(', string(turn), ')"}')""")
        + ", NULL)",
    )
    delta = {**message, "type": "'model.message.delta'"}
    middle = _event(**delta, seq="pos + if(swapped, 4, 5)", content_text="substring(text, half + 1, quarter)")
    rest = _event(**delta, seq="pos + 6", content_text="substring(text, half + quarter + 1)")
    answer = _event(
        seq="pos + 8", id="concat('t-', string(conv_id), '-', string(turn))", type="'tool.response'", thread_id="thread",
        content_text=_BODY, content_kind="'text'",
    )
    created = _event(
        seq="pos + 3", id="concat('th-', string(conv_id))", type="'thread.created'", thread_id="thread",
        content_text="text", content_kind="'text'",
    )
    turn = _event(seq="pos", id="concat('turn-', sid)", type="'turn.created'", turn_id="concat('turn-', sid)")
    box = _event(seq="pos + 1", id="concat('box-', sid)", type="'sandbox.created'", sandbox_id="concat('box-', sid)")
    done = _event(seq="900000 + lane", id="concat('d-', string(conv_id))", type="'thread.done'", thread_id="thread")
    return [
        f"if(role = 'assistant', {base}, NULL)", f"if(role = 'assistant', {middle}, NULL)",
        f"if(role = 'assistant', {rest}, NULL)", f"if(role = 'user', {answer}, NULL)",
        f"if(role = 'system', {created}, NULL)", f"if(opening, {turn}, NULL)", f"if(opening AND s % 2 = 0, {box}, NULL)",
        f"if(turn = 0 AND lane <> 0 AND s % 5 = 0, {done}, NULL)",
    ]


def _round_events() -> str:
    """Sessions divisible by 3 ask for release.

    0 to 5 denials, then an allow below 4; even sessions then ask again, are denied once and allowed.  In
    sessions divisible by 5 the last request stays undecided.
    """
    tag, start = "concat(sid, '-', string(r))", "1000000 + r * 4"
    call, source = f"concat('call-', {tag})", f"concat('p-', {tag})"
    proposal = """concat('{"title":"Summary ', sid, '","summary":"round ', string(r), '"}')"""
    asked = _event(
        seq=start, id=source, type="'model.message'", thread_id="'main'",
        tool_calls=_call(call, "NULL", f"'{RELEASE_TOOL}'", proposal),
    )
    pending = _event(
        seq=f"{start} + 1", id=f"concat('a-', {tag})", type="'tool.approval_required'", thread_id="'main'",
        tool_calls=_call(call, f"if(s % 2 = 0, {source}, NULL)", "NULL", "NULL"),
    )
    decision = _event(
        seq=f"{start} + 2", id=call, type="'user.tool_approval'", thread_id="'main'",
        approval="named_struct('status', if(r < denials OR r = denials + 1, 'deny', 'allow'), "
        "'reason', if(r < denials OR r = denials + 1, concat('revise ', string(r)), NULL))",
    )
    count = "int(if(denials < 4, denials + if(s % 2 = 0, 3, 1), denials))"
    decided = f"if(s % 5 = 0 AND r = {count} - 1, NULL, {decision})"
    rounds = f"flatten(transform(sequence(0, {count} - 1), r -> array({asked}, {pending}, {decided})))"
    return f"if({count} = 0, array(), filter({rounds}, e -> e IS NOT NULL))"


def event_log(conversations: DataFrame) -> DataFrame:
    placed = conversations.selectExpr(
        "conv_id", "turn", "role", "text", "conv_id div 4 AS s", "conv_id % 4 AS lane", "turn * 64 + (conv_id % 4) * 16 AS pos",
        "if(conv_id % 4 = 0, 'main', concat('sub-', string(conv_id))) AS thread", "string(conv_id div 4) AS sid",
        "concat('m-', string(conv_id), '-', string(turn)) AS message", "int(length(text) div 2) AS half",
        "int(length(text) div 4) AS quarter", "(conv_id * 8 + turn) % 25 = 0 AS swapped",
        "turn = 0 AND conv_id % 4 = 0 AS opening", "((conv_id div 4) div 3) % 6 AS denials",
    )
    events = f"filter(array({', '.join(_message_events())}), e -> e IS NOT NULL)"
    events = f"CASE WHEN opening AND s % 3 = 0 THEN concat({events}, {_round_events()}) ELSE {events} END"
    content = (
        "CASE content_kind WHEN 'parts' THEN parse_json(to_json(array(named_struct('type', 'text', 'text', content_text)))) "
        "WHEN 'text' THEN CAST(content_text AS variant) END AS content"
    )
    return placed.selectExpr("sid AS session_id", f"inline({events})").selectExpr(
        "session_id", "seq", "id", "type", "thread_id", content, "reasoning_content", "tool_calls", "turn_id",
        "sandbox_id", "approval",
    )


def release_log(conversations: DataFrame) -> DataFrame:
    """Released reports: at the first approval, but before it in every 4th session, twice in every 9th, never in
    every 15th; and some in sessions that never asked."""
    return (
        conversations.where("turn = 0 AND conv_id % 4 = 0").selectExpr("conv_id div 4 AS s")
        .selectExpr("s", "(s div 3) % 6 AS denials")
        .where("(s % 3 = 0 AND s % 15 <> 0) OR s % 21 = 1")
        .selectExpr("s", "denials", "explode(sequence(0, if(s % 9 = 0, 1, 0))) AS copy")
        .selectExpr(
            "string(s) AS session_id", "1000003 + denials * 4 - if(s % 4 = 0, 3, 0) + copy AS at",
            "concat('Summary ', string(s)) AS title",
        )
    )


_CHUNKS = "substr(text, 1, length(text)//2)", "substr(text, length(text)//2 + 1, length(text)//4)", (
    "substr(text, length(text)//2 + length(text)//4 + 1)"
)

# The same log after merging, written independently of the Spark operators.
MERGED_SQL = f"""
conv AS (SELECT *, conv_id//4 AS s, conv_id%4 AS lane, turn*64 + (conv_id%4)*16 AS pos,
    CASE WHEN conv_id%4 = 0 THEN 'main' ELSE 'sub-' || conv_id::VARCHAR END AS thread,
    {_CHUNKS[0]} AS h, {_CHUNKS[1]} AS q, {_CHUNKS[2]} AS r,
    (conv_id*8 + turn)%25 = 0 AS swapped
  FROM conversations),
rounds AS (SELECT *, s%5 = 0 AND r = n - 1 AS undecided, r < denials OR r = denials + 1 AS denied
  FROM (SELECT *, unnest(range(n)) AS r FROM (SELECT s, (s//3)%6 AS denials,
      CASE WHEN (s//3)%6 < 4 THEN (s//3)%6 + CASE WHEN s%2 = 0 THEN 3 ELSE 1 END ELSE (s//3)%6 END AS n
    FROM conv WHERE turn = 0 AND lane = 0 AND s%3 = 0))),
results AS (SELECT *, CASE WHEN (conv_id + turn)%30 = 0 THEN '' ELSE 'log ok' || chr(10)
    || '{{"check":"scrub","schema_version":1,"run_id":"' || CASE WHEN lane = 1 THEN 'run-old' ELSE 'run-' || s::VARCHAR END
    || '","passed":true,"row_count":' || CASE WHEN lane = 2 THEN '"many"' ELSE turn::VARCHAR END
    || ',"columns":["arm"],"surviving_identifier_columns":[],"canary_present":null}}' || chr(10) || text
    || CASE WHEN conv_id%13 = 5 THEN chr(10) || 'row STUDY-' || lpad(conv_id::VARCHAR, 7, '0') || ' p' || conv_id::VARCHAR
         || '@example.com end' ELSE '' END END AS output
  FROM conv WHERE role = 'user'),
merged AS (
  SELECT s::VARCHAR AS session_id, thread AS thread_id, 'm-' || conv_id::VARCHAR || '-' || turn::VARCHAR AS id,
    pos + 4 AS first_seq, pos + 6 AS last_seq, 'model.message' AS type,
    CASE WHEN NOT swapped THEN h || q WHEN q = '' OR contains(h, q) THEN h WHEN h = '' OR contains(q, h) THEN q
         ELSE h || chr(10) || q END || r AS text,
    CASE WHEN conv_id%7 = 0 THEN 'weighing turn ' || turn::VARCHAR ELSE '' END AS reasoning,
    CASE WHEN conv_id%5 = 0 THEN '{{"code":"step(' || turn::VARCHAR || ')"}}' ELSE '' END AS arguments
  FROM conv WHERE role = 'assistant'
  UNION ALL
  SELECT s::VARCHAR, thread, 't-' || conv_id::VARCHAR || '-' || turn::VARCHAR, pos + 8, pos + 8, 'tool.response',
    CASE WHEN (conv_id + turn)%30 = 0 THEN '{{"success":false}}' ELSE '{{"success":true,"response":{{"exitCode":'
      || CASE WHEN (conv_id + turn)%10 = 0 THEN '1' ELSE '0' END || ',"result":' || to_json(output)::VARCHAR || '}}}}' END, '', ''
  FROM results
  UNION ALL
  SELECT s::VARCHAR, thread, 'th-' || conv_id::VARCHAR, pos + 3, pos + 3, 'thread.created', text, '', '' FROM conv WHERE role = 'system'
  UNION ALL
  SELECT s::VARCHAR, '__turn__', 'turn-' || s::VARCHAR, pos, pos, 'turn.created', '', '', '' FROM conv WHERE turn = 0 AND lane = 0
  UNION ALL
  SELECT s::VARCHAR, '__turn__', 'box-' || s::VARCHAR, pos + 1, pos + 1, 'sandbox.created', '', '', '' FROM conv WHERE turn = 0 AND lane = 0 AND s%2 = 0
  UNION ALL
  SELECT s::VARCHAR, thread, 'd-' || conv_id::VARCHAR, 900000 + lane, 900000 + lane, 'thread.done', '', '', ''
  FROM conv WHERE turn = 0 AND lane <> 0 AND s%5 = 0
  UNION ALL
  SELECT s::VARCHAR, 'main', 'p-' || s::VARCHAR || '-' || r::VARCHAR, 1000000 + r*4, 1000000 + r*4, 'model.message', '', '',
    '{{"title":"Summary ' || s::VARCHAR || '","summary":"round ' || r::VARCHAR || '"}}' FROM rounds
  UNION ALL
  SELECT s::VARCHAR, 'main', 'a-' || s::VARCHAR || '-' || r::VARCHAR, 1000001 + r*4, 1000001 + r*4, 'tool.approval_required', '', '', '' FROM rounds
  UNION ALL
  SELECT s::VARCHAR, 'main', 'call-' || s::VARCHAR || '-' || r::VARCHAR, 1000002 + r*4, 1000002 + r*4, 'user.tool_approval', '', '', '' FROM rounds WHERE NOT undecided)"""
