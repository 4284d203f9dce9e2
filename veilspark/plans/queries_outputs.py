"""Queries on outputs, assets, tokens, events, sources, sinks and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from veilspark.functions import fixed_values as V
from veilspark.functions import text as T
from veilspark.operators import asset_index as IX
from veilspark.operators import assets as A
from veilspark.operators import events as E
from veilspark.operators import leakage as LK
from veilspark.operators import outputs as O
from veilspark.operators import tokens as TK
from veilspark.plans import registry
from veilspark.plans.probes import with_probes
from veilspark.plans.registry import ASSETS_SQL, OUTPUTS, PROMPTS, TURNS, case, has, outputs, prompts, query, quoted, rows, rx, table, tags, turns
from veilspark.sources import documents as D
from veilspark.sources import models as M
from veilspark.streaming import monitor as ST
from veilspark.streaming import watch as WT

ID = ("conv_id", "turn")


def words():
    """The text column; made at call time, as the module is imported before there is a session."""
    return F.col("text")


csv = lambda c: F.array_join(c, ",")
L = "lower(text)"
WATCHED = [(v, r) for _, _, t, v, _, r, *_ in V.ASSETS if t == "exact"]
WORDS = ["sk-abcdefgh", "hunter22"]


def folder(spark, name: str) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def out(name, column, sql, source=outputs, base=OUTPUTS):
    query(name, f"{base} SELECT conv_id, turn, {sql} AS out FROM c" if sql else None)(lambda spark, d: source(spark, d).select(*ID, column().alias("out")))


# ---- output guard -----------------------------------------------------------------------------------------

PATTERNS_SQL = {n: f"regexp_matches(text, {quoted(p[0])})" for n, p in sorted(V.SECRET_PATTERNS.items())}
out("PRD11", lambda: csv(O.pattern_names(words())), tags(**PATTERNS_SQL))
out("SRC9", lambda: csv(O.pattern_names(words(), O.with_pattern(V.SECRET_PATTERNS, "zz_custom", "[a-z]+ pirate"))), tags(**PATTERNS_SQL, zz_custom="regexp_matches(text, '[a-z]+ pirate')"))
out("FN13", lambda: O.redact_patterns(words()), "regexp_replace(" * len(V.SECRET_PATTERNS) + "text" + "".join(f", {quoted(p[0])}, {quoted(p[4])}, 'g')" for p in V.SECRET_PATTERNS.values()))

HIT_SQL = f"""ah AS (SELECT conv_id, turn, asset_id, risk_level, CASE WHEN list_contains(modes, 'exact_match') AND contains({L}, lower(value)) THEN 'exact'
  WHEN list_contains(modes, 'exact_match') AND len(list_filter(aliases, lambda w: contains({L}, lower(w)))) > 0 THEN 'alias'
  WHEN list_contains(modes, 'partial_match') AND len(list_filter(range(1, length(value) - 2), lambda i: contains({L}, substr(lower(value), i, 4)))) > 0 THEN 'partial' END AS kind FROM c, a)"""


@query("JOIN5", f"{OUTPUTS}, {ASSETS_SQL}, {HIT_SQL} SELECT conv_id, turn, asset_id, kind FROM ah WHERE kind IS NOT NULL")
def join5(spark, d):
    return outputs(spark, d).select(*ID, F.explode(O.asset_hits(words(), A.literal())).alias("h")).select(*ID, "h.asset_id", "h.kind")




@query("AGG13", f"""{OUTPUTS}, {ASSETS_SQL}, {HIT_SQL}, w AS (SELECT conv_id, turn, bool_or(kind IN ('exact', 'alias')) AS whole, bool_or(kind = 'partial') AS part FROM ah GROUP BY ALL),
z AS (SELECT c.*, coalesce(whole, false) AS whole, coalesce(part, false) AS part, {rx('text', [p[0] for p in V.SECRET_PATTERNS.values() if p[3] == 'BLOCK'])} AS grave, {rx('text', [p[0] for p in V.SECRET_PATTERNS.values() if p[3] == 'REDACT'])} AS plain FROM c JOIN w ON w.conv_id = c.conv_id AND w.turn = c.turn)
SELECT conv_id, turn, CASE WHEN whole OR grave THEN 'BLOCK' WHEN part OR plain THEN 'REDACT' ELSE 'ALLOW' END AS action, CASE WHEN whole OR grave THEN 'CRITICAL_LEAK' WHEN plain THEN 'FULL_LEAK' WHEN part THEN 'PARTIAL_LEAK' ELSE 'NO_LEAK' END AS risk_level FROM z""")
def agg13(spark, d):
    return O.inspect(outputs(spark, d), A.literal(), redact=False).select(*ID, "action", "risk_level")


@query("FN13_assets")
def fn13_assets(spark, d):
    return O.inspect(outputs(spark, d), A.literal()).select(*ID, "safe_output", "is_redacted", csv("matched_assets").alias("assets"))


# ---- leakage ----------------------------------------------------------------------------------------------------

SECRETS = [("s1", "name one", "exact", "Project-Shadow", ["pirate", "Shadow"], "high", ["owner"], LK.MODES, "", "user"), ("s2", "name two", "exact", "not_a_real_flag", ["flag"], "high", ["owner"], LK.MODES, "", "user")]
SECRETS_SQL = rows("a", "asset_id, name, type, value, aliases, risk_level, allowed_roles, modes, description, source", SECRETS)
GRAM_SQL = "g AS (SELECT DISTINCT asset_id, value, substr(value, i, 4) AS gram FROM (SELECT asset_id, value, unnest(range(1, length(value) - 2)) AS i FROM a))"


def leaked(spark, d):
    x = outputs(spark, d).withColumn("text", F.when(F.col("turn") % 5 == 0, F.concat(words(), F.lit(" "), T.to_base64(F.lit("Project-Shadow")))).when(F.col("turn") % 5 == 1, F.concat(words(), F.lit(" "), T.rot13(F.lit("not_a_real_flag")))).otherwise(words()))
    return LK.verify(x, A.literal(SECRETS))


LEAK_TEXT = f"t AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN text || ' ' || base64(encode('Project-Shadow')) WHEN 1 THEN text || ' abg_n_erny_synt' ELSE text END AS text FROM c)"


def leak(name, kind, where, extra="", cols="'x'"):
    @query(name, f"{OUTPUTS}, {SECRETS_SQL}, {GRAM_SQL}, {LEAK_TEXT} {where}")
    def q(spark, d):
        return leaked(spark, d).select(*ID, F.explode("leaks").alias("m")).filter(F.col("m.leak_type").isin(kind)).select(*ID, "m.asset_id", "m.match_type", F.round("m.confidence", 4).alias("confidence"))


leak("FN9", ["full_leak", "partial_leak", "encoding_leak"], f"""SELECT conv_id, turn, asset_id, 'exact' AS match_type, 1.0::DOUBLE AS confidence FROM t, a WHERE contains({L}, lower(value))
UNION ALL SELECT conv_id, turn, asset_id, 'partial', least(0.9, round(count(*) FILTER (contains({L}, lower(gram))) / count(*), 4))::DOUBLE FROM t, g WHERE NOT regexp_matches(gram, '[{{}}_\\- .,!?:;]') GROUP BY conv_id, turn, asset_id HAVING count(*) FILTER (contains({L}, lower(gram))) > 0
UNION ALL SELECT conv_id, turn, asset_id, 'base64', 1.0 FROM t, a WHERE contains({L}, lower(base64(encode(value)))) UNION ALL SELECT conv_id, turn, asset_id, 'hex', 1.0 FROM t, a WHERE contains({L}, lower(hex(value)))
UNION ALL SELECT conv_id, turn, asset_id, 'url_encoding', 1.0 FROM t, a WHERE contains({L}, lower(value)) UNION ALL SELECT conv_id, turn, asset_id, 'rot13', 1.0 FROM t, a WHERE contains({L}, CASE asset_id WHEN 's1' THEN 'cebwrpg-funqbj' ELSE 'abg_n_erny_synt' END)""")
leak("FN10", ["reconstruction_leak"], f"""SELECT conv_id, turn, asset_id, 'reconstruction' AS match_type, round(least(1.0, 4.0 * count(*) / min(length(value)) + CASE WHEN count(*) >= 2 THEN 0.2 ELSE 0 END), 2)::DOUBLE AS confidence
FROM t, (SELECT DISTINCT asset_id, value, lower(gram) AS gram FROM g) AS g WHERE contains({L}, gram) GROUP BY conv_id, turn, asset_id HAVING 4.0 * count(*) / min(length(value)) >= 0.6""")
leak("FN11", ["translation_leak", "semantic_leak"], f"""SELECT conv_id, turn, asset_id, match_type, round(least(1.0, n / len(aliases) + plus), 2)::DOUBLE AS confidence FROM (SELECT conv_id, turn, asset_id, aliases, len(list_filter(aliases, lambda w: contains({L}, lower(w)))) AS n FROM t, a) AS z,
(VALUES ('alias', 0.3), ('semantic_alias', 0.2)) AS k(match_type, plus) WHERE n > 0""")


CODES = {"s1": [T.literal_base64("Project-Shadow"), "Project-Shadow".encode().hex(), "Project-Shadow", "Cebwrpg-Funqbj"], "s2": [T.literal_base64("not_a_real_flag"), "not_a_real_flag".encode().hex(), "not_a_real_flag", "abg_n_erny_synt"]}
PLAIN_GRAM = "NOT regexp_matches(gram, '[{}_\\- .,!?:;]')"
LEAKS_SQL = f"""{OUTPUTS}, {SECRETS_SQL}, {GRAM_SQL}, {LEAK_TEXT}, lk AS (
  SELECT conv_id, turn, 'full_leak' AS kind, 4 AS worst FROM t, a WHERE contains({L}, lower(value))
  UNION ALL SELECT conv_id, turn, 'partial_leak', 3 FROM t, g WHERE {PLAIN_GRAM} AND contains({L}, lower(gram))
  UNION ALL SELECT conv_id, turn, 'encoding_leak', 4 FROM t WHERE {has(L, [c.lower() for cs in CODES.values() for c in cs])}
  UNION ALL SELECT conv_id, turn, 'reconstruction_leak', 3 FROM t, (SELECT DISTINCT asset_id, value, lower(gram) AS gram FROM g) AS g WHERE contains({L}, gram) GROUP BY conv_id, turn, asset_id HAVING 4.0 * count(*) / min(length(value)) >= 0.6
  UNION ALL SELECT conv_id, turn, kind, CASE WHEN kind = 'translation_leak' OR n >= 2 THEN 3 ELSE 2 END FROM (SELECT conv_id, turn, len(list_filter(aliases, lambda w: contains({L}, lower(w)))) AS n FROM t, a) AS z, (VALUES ('translation_leak'), ('semantic_leak')) AS k(kind) WHERE n > 0)"""


@query("AGG12", f"""{LEAKS_SQL} SELECT t.conv_id, t.turn, count(kind) > 0 AS is_leak, CASE coalesce(max(worst), 0) {' '.join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(V.LEAK_SEVERITIES))} END AS highest_severity, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS leak_types,
  CASE WHEN max(worst) >= 3 THEN 'block' WHEN count(kind) > 0 THEN 'redact' ELSE 'allow' END AS recommended_action FROM t LEFT JOIN lk ON lk.conv_id = t.conv_id AND lk.turn = t.turn GROUP BY t.conv_id, t.turn""")
def agg12(spark, d):
    return leaked(spark, d).select(*ID, "is_leak", "highest_severity", csv("leak_types").alias("leak_types"), "recommended_action")


def _redaction_sql() -> str:
    """Whole leaks first, then each asset's other leaks in order; a step replaces the first occurrence, in its own letter case, unless its placeholder is there."""
    steps = [("full_leak", quoted(v), f"contains({L}, {quoted(v.lower())})") for _, _, _, v, *_ in SECRETS]
    for i, _, _, v, aliases, *_ in SECRETS:
        grams = list(dict.fromkeys(v[k : k + 4] for k in range(len(v) - 3)))
        plain = [g for g in grams if not any(c in "{}_- .,!?:;" for c in g)]
        low = sorted({g.lower() for g in grams})
        first = lambda words: "coalesce(" + ", ".join(f"CASE WHEN contains({L}, {quoted(w.lower())}) THEN {quoted(w)} END" for w in words) + ", '')"
        steps.append(("partial_leak", first(plain), "true"))
        steps += [("encoding_leak", quoted(c), f"contains({L}, {quoted(c.lower())})") for c in CODES[i]]
        count = " + ".join(f"contains({L}, {quoted(g)})::INT" for g in low)
        steps.append(("reconstruction_leak", first(low), f"4.0 * ({count}) / {len(v)} >= 0.6"))
        steps += [(k, first(aliases), "true") for k in ("translation_leak", "semantic_leak")]
    out, before = "", "t"
    for n, (kind, what, cond) in enumerate(steps):
        sign = quoted(V.LEAK_PLACEHOLDERS[kind])
        done = "text" if before == "t" else "done"
        out += f", d{n} AS (SELECT conv_id, turn, text, CASE WHEN ({cond}) AND {what} <> '' AND contains({done}, {what}) AND NOT contains({done}, {sign}) THEN substr({done}, 1, instr({done}, {what}) - 1) || {sign} || substr({done}, instr({done}, {what}) + length({what})) ELSE {done} END AS done FROM {before})"
        before = f"d{n}"
    return f"{OUTPUTS}, {LEAK_TEXT}{out} SELECT conv_id, turn, done AS redacted_output FROM {before}"


@query("FN12", _redaction_sql())
def fn12(spark, d):
    return leaked(spark, d).select(*ID, "redacted_output")


for _n, _same in (("JOIN4", "AGG12"), ("SRT6", "FN12")):
    query(_n, registry.ORACLES[_same])(registry.QUERIES[_same])


@query("WIN9", f"""{OUTPUTS}, {SECRETS_SQL}, {GRAM_SQL}, x AS (SELECT c.conv_id, c.turn, lower(gram) AS gram FROM c, g WHERE asset_id = 's2' AND contains({L}, lower(gram))), f AS (SELECT conv_id, gram, min(turn) AS since FROM x GROUP BY ALL)
SELECT c.conv_id, c.turn, coalesce(string_agg(gram, ',' ORDER BY gram), '') AS pieces FROM c LEFT JOIN f ON f.conv_id = c.conv_id AND since < c.turn GROUP BY c.conv_id, c.turn""")
def win9(spark, d):
    return LK.session_pieces(outputs(spark, d), "conv_id", "turn", "not_a_real_flag").select(*ID, csv("accumulated_fragments").alias("pieces"))


# ---- tokens -----------------------------------------------------------------------------------------------------

TOKEN_ROWS = [{"asset_id": i, "token": t, "token_type": k, "risk_level": r} for i, _, _, v, al, r, *_ in V.ASSETS for k, ts in (("exact", [v]), ("alias", al)) for t in ts] + [{"asset_id": "x", "token": "shadow", "token_type": "normalized", "risk_level": "high"}, {"asset_id": "x", "token": "DEPLOY-KEY", "token_type": "partial", "risk_level": "high"}]
TOKENS_SQL = rows("tk", "asset_id, token, token_type, risk_level", [tuple(r.values()) for r in TOKEN_ROWS])
EDGE = r"'(^|[^\pL\pN_])'"
TOKEN_HITS = rf"""th AS (SELECT conv_id, turn, text, tk.* FROM c JOIN tk ON CASE token_type WHEN 'exact' THEN contains({L}, lower(token)) WHEN 'partial' THEN contains({L}, lower(token))
  WHEN 'normalized' THEN contains(lower(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')), lower(token)) WHEN 'alias' THEN contains({L}, lower(token)) AND (regexp_matches(token, '[一-鿿]') OR
  regexp_matches(substr(' ' || {L} || ' ', instr({L}, lower(token)), 1) || substr(' ' || {L} || ' ', instr({L}, lower(token)) + length(token) + 1, 1), '^[^\pL\pN_][^\pL\pN_]$')) END)"""


def guarded(spark, d):
    return TK.guard(prompts(spark, d), TK.as_literal(TOKEN_ROWS), decode_escapes=False)


@query("JOIN3", f"{PROMPTS}, {TOKENS_SQL}, {TOKEN_HITS} SELECT DISTINCT conv_id, turn, asset_id, token, token_type FROM th")
def join3(spark, d):
    return guarded(spark, d).select(*ID, F.explode("token_matches").alias("m")).select(*ID, "m.asset_id", F.col("m.matched_text").alias("token"), F.col("m.match_type").alias("token_type")).distinct()


query("SET4", f"{PROMPTS}, {TOKENS_SQL}, {TOKEN_HITS} SELECT DISTINCT conv_id, turn, asset_id, token, token_type FROM th")(join3)
INTENT = f"({has('text', V.EXTRACTION_ZH)} OR {has(L, V.EXTRACTION_EN)})"


@query("DEC6", f"""{PROMPTS}, {TOKENS_SQL}, {TOKEN_HITS}, z AS (SELECT c.conv_id, c.turn, any_value({INTENT.replace('text', 'c.text')}) AS intent, any_value({has('lower(c.text)', V.TEACHING)}) AS teach, count(token) AS n, coalesce(bool_or(token_type = 'exact' AND risk_level IN ('high', 'critical')), false) AS grave,
  coalesce(bool_or(token_type = 'partial'), false) AS part, coalesce(bool_or(token_type = 'normalized'), false) AS norm, coalesce(bool_or(token_type = 'alias'), false) AS al FROM c LEFT JOIN th ON th.conv_id = c.conv_id AND th.turn = c.turn GROUP BY c.conv_id, c.turn)
SELECT conv_id, turn, CASE WHEN n = 0 THEN 'ALLOW' WHEN grave THEN 'BLOCK' WHEN part OR norm THEN CASE WHEN intent THEN 'BLOCK' ELSE 'ESCALATE' END WHEN al AND teach AND NOT intent THEN 'WARN' WHEN al AND intent THEN 'BLOCK' WHEN al THEN 'RESTRICT' ELSE 'ALLOW' END AS action FROM z""")
def dec6(spark, d):
    return guarded(spark, d).select(*ID, F.col("token_verdict.action").alias("action"))


@query("DEC7", f"""{PROMPTS}, {TOKENS_SQL}, {TOKEN_HITS}, z AS (SELECT c.conv_id, c.turn, any_value({INTENT.replace('text', 'c.text')}) AS intent, any_value({has('lower(c.text)', V.TEACHING)}) AS teach, count(token) AS n, coalesce(bool_or(token_type IN ('exact', 'partial', 'alias')), false) AS leak, coalesce(bool_or(token_type = 'normalized'), false) AS norm FROM c LEFT JOIN th ON th.conv_id = c.conv_id AND th.turn = c.turn GROUP BY c.conv_id, c.turn)
SELECT conv_id, turn, n = 0 AS allowed, CASE WHEN leak THEN 'REWRITE_REQUIRED' WHEN n = 0 THEN 'ALLOW' WHEN intent THEN 'BLOCK' ELSE 'ESCALATE' END AS action, CASE WHEN leak THEN 'critical' WHEN n = 0 THEN 'low' ELSE 'high' END AS risk_level,
  CASE WHEN leak THEN 'protected_prompt_contains_secret' WHEN n = 0 THEN 'protected_prompt_is_clean' WHEN intent THEN 'normalized variant with extraction intent' ELSE 'normalized variant detected' END AS note FROM z""")
def dec7(spark, d):
    return guarded(spark, d).select(*ID, TK.prompt_verdict(F.col("token_matches"), F.col("token_verdict")).alias("v")).select(*ID, "v.*")


out("PRD13", lambda: F.concat_ws(",", TK.extraction_intent(words()), TK.teaching(words())), f"concat_ws(',', {INTENT}, {has(L, V.TEACHING)})", prompts, PROMPTS)
SYN = sorted({t for k in ("token", "secret") for t in [k, *V.TOKEN_SYNONYMS[k]]})
out("FN20", lambda: csv(TK.simple_guard(words(), ["token", "secret"])["matched_tokens"]), "concat_ws(',', " + ", ".join(f"CASE WHEN contains({L}, {quoted(t)}) THEN {quoted(t)} END" for t in SYN) + ")", prompts, PROMPTS)


# ---- assets -----------------------------------------------------------------------------------------------------


@query("JOIN14", f"""{PROMPTS}, {rows('w', 'n, term, word', [(100 * i + j, e, w) for i, (e, ws) in enumerate(V.TRANSLATIONS.items()) for j, w in enumerate(ws)])}, z AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || ' 密碼' WHEN 1 THEN text || ' 通關碼' ELSE text END AS text FROM c)
SELECT conv_id, turn, arg_min(word, n) AS matched, arg_min(term, n) AS source_term FROM z JOIN w ON contains({L}, word) AND (contains({L}, term) OR contains('password', term)) GROUP BY conv_id, turn""")
def join14(spark, d):
    x = prompts(spark, d).withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat(words(), F.lit(" 密碼"))).when(F.col("turn") % 3 == 1, F.concat(words(), F.lit(" 通關碼"))).otherwise(words()))
    return x.select(*ID, A.translation_match(words(), F.lit("password"), F.lit("x")).alias("m")).filter("m IS NOT NULL").select(*ID, "m.matched", "m.source_term")


@query("JOIN15", f"""{PROMPTS}, {ASSETS_SQL}, z AS (SELECT conv_id, turn, text, a.*, list_filter(string_split(lower(replace(description, ',', ' ')), ' '), lambda w: length(w) > 2) AS ws FROM c, a)
SELECT conv_id, turn, asset_id, CASE WHEN contains({L}, lower(name)) THEN 'semantic_name' WHEN len(list_filter(aliases, lambda w: contains({L}, lower(w)))) > 0 THEN 'semantic_alias' ELSE 'semantic_description' END AS mode FROM z
WHERE contains({L}, lower(name)) OR len(list_filter(aliases, lambda w: contains({L}, lower(w)))) > 0 OR (len(list_filter(ws, lambda w: contains({L}, w))) > 0 AND len(list_filter(ws, lambda w: contains({L}, w))) >= 0.5 * len(ws))""")
def join15(spark, d):
    found = F.filter(F.transform(A.literal(), lambda a: F.struct(a["asset_id"].alias("asset_id"), A.semantic_match(words(), a).alias("m"))), lambda r: r["m"].isNotNull())
    return prompts(spark, d).select(*ID, F.explode(found).alias("r")).select(*ID, "r.asset_id", F.col("r.m.mode").alias("mode"))


REBUILT_VALUE = "not_a_real_flag"
_N = len(REBUILT_VALUE)
_PIECES = "[" + ", ".join(f"coalesce({', '.join(f'CASE WHEN contains(p, {quoted(REBUILT_VALUE[i:i + k])}) THEN {quoted(REBUILT_VALUE[i:i + k])} END' for i in range(_N - k + 1))})" for k in range(_N, 2, -1)) + "]"
REBUILT_SQL = rf"""{PROMPTS}, z AS (SELECT conv_id, turn, text, regexp_replace({L}, '\s+', '', 'g') AS p FROM c), y AS (SELECT conv_id, turn, text, list_filter({_PIECES}, lambda s: s IS NOT NULL) AS found, ({' + '.join(f'contains(p, {quoted(ch)})::INT' for ch in REBUILT_VALUE)}) / {_N} AS loose FROM z),
x AS (SELECT *, coalesce(length(found[1]), 0) AS best FROM y)
SELECT conv_id, turn, CASE WHEN best >= 3 THEN best WHEN loose >= 0.7 AND text <> '' THEN 0 END AS longest_match, CASE WHEN best >= 3 OR (loose >= 0.7 AND text <> '') THEN {_N} END AS total_length, CASE WHEN best >= 3 THEN round_even(best / {_N}, 2) WHEN loose >= 0.7 AND text <> '' THEN round_even(loose, 2) END AS coverage_ratio,
  CASE WHEN best >= 3 THEN CASE WHEN best / {_N} >= 0.8 THEN 'high' WHEN best / {_N} >= 0.5 THEN 'medium' ELSE 'low' END WHEN loose >= 0.7 AND text <> '' THEN CASE WHEN loose >= 0.8 THEN 'medium' ELSE 'low' END END AS risk_level,
  CASE WHEN best >= 0.8 * {_N} THEN found[1] WHEN best >= 3 THEN array_to_string(found[1:5], '|') WHEN loose >= 0.7 AND text <> '' THEN '' END AS segments FROM x"""


@query("JOIN16", REBUILT_SQL)
def join16(spark, d):
    found = prompts(spark, d).select(*ID, A.reconstruction_match(words(), F.lit(REBUILT_VALUE)).alias("m"))
    return found.select(*ID, "m.longest_match", "m.total_length", "m.coverage_ratio", "m.risk_level", F.array_join("m.matched_segments", "|").alias("segments"))


query("SRT4", REBUILT_SQL)(join16)

SECRET_SQL = rf"""{PROMPTS}, {ASSETS_SQL}, ge AS (SELECT asset_id, value, list_filter(list_transform(range(1, length(value) - 2), lambda i: substr(value, i, 4)), lambda w: NOT regexp_matches(w, '[{{}}_\- .,!?:;]')) AS grams FROM a),
z AS (SELECT conv_id, turn, a.asset_id, (list_contains(modes, 'exact_match') AND contains(text, a.value)) OR (list_contains(modes, 'case_insensitive_match') AND contains({L}, lower(a.value))) AS exact, text, a.value, aliases, modes, grams FROM c, a JOIN ge ON ge.asset_id = a.asset_id WHERE length(a.value) > 0),
y AS (SELECT conv_id, turn, asset_id, list_concat(list_concat(CASE WHEN exact THEN [value] ELSE [] END, CASE WHEN list_contains(modes, 'alias_match') THEN list_filter(aliases, lambda w: contains({L}, lower(w))) ELSE [] END),
  list_concat(CASE WHEN list_contains(modes, 'encoding_match') THEN list_filter([base64(encode(value)), lower(hex(encode(value)))], lambda e: contains(text, e)) ELSE [] END, CASE WHEN list_contains(modes, 'partial_match') AND NOT exact THEN list_filter(grams, lambda w: contains({L}, lower(w))) ELSE [] END)) AS found FROM z)
SELECT conv_id, turn, asset_id, array_to_string(list_filter(found, lambda w, i: list_position(found, w) = i), '|') AS fragments FROM y WHERE len(found) > 0"""


@query("JOIN17", SECRET_SQL)
def join17(spark, d):
    return prompts(spark, d).select(*ID, F.explode(A.secret_match(words(), A.literal())).alias("m")).select(*ID, "m.asset_id", F.array_join("m.matched_fragments", "|").alias("fragments"))


# ---- events -----------------------------------------------------------------------------------------------------

EVENT_ACTIONS = {"click": "ALLOW", "view": "WARN", "purchase": "RESTRICT", "signup": "REWRITE", "error": "BLOCK"}


def events(spark, d):
    x = table(spark, d, "events")
    kind = F.col("event_type")
    action = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in EVENT_ACTIONS.items()), F.lit("ESCALATE"))
    return x.select("event_id", F.col("user_id").cast("string").alias("session_id"), kind.alias("attack_type"), action.alias("policy_action"), F.greatest(F.lit(0), F.least(F.lit(100), F.round("value").cast("int"))).alias("risk_score"), (kind == "error").alias("blocked"), (F.col("event_id") % 10 == 0).alias("leakage_detected"), F.when(F.col("event_id") % 20 == 0, "full_leak").otherwise("partial_leak").alias("leakage_type"), F.array(F.concat(F.lit("skill_"), (F.col("event_id") % 3).cast("string"))).alias("enabled_skills"))


EVENTS_SQL = f"WITH e AS (SELECT event_id, user_id, event_type AS attack_type, {case('event_type', EVENT_ACTIONS, quoted('ESCALATE'))} AS policy_action, greatest(0, least(100, CAST(round(value) AS INTEGER))) AS risk_score, event_type = 'error' AS blocked, event_id % 10 = 0 AS leak, CASE WHEN event_id % 20 = 0 THEN 'full_leak' ELSE 'partial_leak' END AS leak_type, 'skill_' || (event_id % 3) AS skill FROM events)"


def _common(column: str) -> str:
    return f"(SELECT {column} FROM e GROUP BY {column} ORDER BY count(*) DESC, min(event_id) LIMIT 1)"


@query("AGG14", f"{EVENTS_SQL} SELECT count(*) AS total_events, {', '.join(f'''count(*) FILTER (policy_action = '{a}') AS {a.lower()}_count''' for a in V.ACTIONS)}, count(*) FILTER (leak) AS leakage_count, count(*) FILTER (blocked) AS blocked_count, max(risk_score) AS highest_risk_score, round(avg(risk_score), 1) AS average_risk_score, {_common('attack_type')} AS most_common_attack_type, {_common('policy_action')} AS most_common_policy_action, {_common('skill')} AS most_common_enabled_skill FROM e")
def agg14(spark, d):
    return E.summary(events(spark, d), "event_id")


@query("SRT5", f"{EVENTS_SQL} SELECT {_common('attack_type')} AS v")
def srt5(spark, d):
    return E.summary(events(spark, d), "event_id").select(F.col("most_common_attack_type").alias("v"))


@query("AGG15", f"{EVENTS_SQL} SELECT count(*) AS total_events, count(*) FILTER (blocked) AS blocked_events, round(count(*) FILTER (blocked) / count(*), 3) AS block_rate, (SELECT string_agg(policy_action || ':' || n, ',' ORDER BY policy_action) FROM (SELECT policy_action, count(*) AS n FROM e GROUP BY 1)) AS actions FROM e")
def agg15(spark, d):
    return E.report(events(spark, d)).select("total_events", "blocked_events", "block_rate", csv(F.transform(F.map_entries("action_distribution"), lambda kv: F.concat_ws(":", kv["key"], kv["value"].cast("string")))).alias("actions"))


@query("AGG16", f"{EVENTS_SQL} SELECT count(*) AS total_events, count(*) FILTER (leak) AS leak_events, round(count(*) FILTER (leak) / count(*), 3) AS leak_rate FROM e")
def agg16(spark, d):
    return E.leakage_statistics(events(spark, d)).select("total_events", "leak_events", "leak_rate")


@query("PRD16", f"{EVENTS_SQL} SELECT event_id FROM e WHERE policy_action = 'BLOCK' AND blocked")
def prd16(spark, d):
    return E.where(events(spark, d), policy_action="BLOCK", blocked=True).select("event_id")


for _n, _k in (("SRT2", 7), ("SRT3", 50)):
    query(_n, f"SELECT event_id FROM events ORDER BY event_id DESC LIMIT {_k}")(lambda spark, d, k=_k: E.latest(events(spark, d), k, "event_id").select("event_id"))

REDACT_SQL = "text"
for _p, _r in V.EVENT_PATTERNS:
    REDACT_SQL = f"regexp_replace({REDACT_SQL}, {quoted(_p)}, {quoted(_r)}, 'g')"
out("FN14", lambda: E.redact_text(words()), REDACT_SQL)


@query("FN19", f"{EVENTS_SQL} SELECT user_id::VARCHAR AS session_id, policy_action, risk_score, 'guest' AS user_role, 1 AS conversation_turn, true AS has_id FROM e")
def fn19(spark, d):
    return E.complete(events(spark, d).withColumn("event_id", F.lit(None).cast("string"))).select("session_id", "policy_action", "risk_score", "user_role", "conversation_turn", (F.col("event_id").startswith("evt_") & F.col("timestamp").isNotNull()).alias("has_id"))


query("FN22", f"{EVENTS_SQL} SELECT event_id, round_even(risk_score / 8, 2) AS r, greatest(10, least(90, risk_score)) AS c FROM e")(lambda spark, d: events(spark, d).select("event_id", F.bround(F.col("risk_score") / 8, 2).alias("r"), F.greatest(F.lit(10), F.least(F.lit(90), F.col("risk_score"))).alias("c")))
query("FN23", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", E.iso_time(F.col("ts")).alias("iso")))
query("FN24", "SELECT event_id, '{\"kind\":\"' || event_type || '\",\"note\":\"é\"}' AS j FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", E.json_text(F.col("event_type").alias("kind"), F.lit("é").alias("note")).alias("j")))


# ---- sources and sinks ----------------------------------------------------------------------------------------------


def json_file(spark, value) -> str:
    return D.save_text(spark, E.to_json(value), folder(spark, "rules") + ".json")


def logged(spark, d):
    path = folder(spark, "events")
    x = events(spark, d).withColumns({"event_id": F.col("event_id").cast("string"), "input_summary": F.lit("password=hunter22 sent")})
    D.append_events(x, path)
    return D.read_events(spark, path)


for _n in ("SRC11", "SNK1"):
    query(_n, f"{EVENTS_SQL} SELECT event_id::VARCHAR AS event_id, policy_action, risk_score, '[REDACTED_PASSWORD] sent' AS input_summary FROM e")(lambda spark, d: logged(spark, d).select("event_id", "policy_action", "risk_score", "input_summary"))


@query("SNK3", f"{EVENTS_SQL} SELECT 'json' AS kind, true AS whole UNION ALL SELECT 'html', true UNION ALL SELECT 'markdown', true")
def snk3(spark, d):
    row = E.report(events(spark, d)).first().asDict(True)
    last = [r.asDict() for r in E.latest(events(spark, d), 50, "event_id").collect()]
    made = {"json": E.to_json(row), "html": E.render_html(row, last), "markdown": E.render_markdown(row)}
    done = []
    for kind, body in made.items():
        path = D.save_text(spark, body, folder(spark, kind))
        done.append((kind, "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()) == body))
    return spark.createDataFrame(done, "kind string, whole boolean")


@query("SNK4", f"{EVENTS_SQL} SELECT count(*) AS n, '**Blocked Events**: ' || count(*) FILTER (blocked) AS line FROM e")
def snk4(spark, d):
    row = E.report(events(spark, d)).first().asDict(True)
    return spark.createDataFrame([(row["total_events"], next(x for x in E.render_markdown(row).split("\n") if "Blocked Events" in x))], "n long, line string")


# ---- models and streams -----------------------------------------------------------------------------------------------


def asked(spark, d):
    return prompts(spark, d).select((F.col("conv_id") * 8 + F.col("turn")).alias("key"), words().alias("prompt"))


for _n in ("SRC12", "STR7"):
    query(_n, f"{PROMPTS} SELECT conv_id * 8 + turn AS key, text, true AS success FROM c")(lambda spark, d: M.generate(asked(spark, d), M.EchoClient(), "echo").select("key", "text", "success"))


def chunked(spark, d):
    return outputs(spark, d).select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), words().alias("chunk"))


@query("WIN8", f"{OUTPUTS} SELECT conv_id AS stream_id, turn AS seq, right(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 2000) AS buffer FROM c")
def win8(spark, d):
    return ST.buffers(chunked(spark, d), "stream_id", "seq", "chunk").select("stream_id", "seq", "buffer")


BUFFER_SQL = f"{OUTPUTS}, b AS (SELECT conv_id AS stream_id, turn AS seq, text, lower(right(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 2000)) AS buffer FROM c), m AS (SELECT *, CASE WHEN {has('buffer', [v.lower() for v, _ in WATCHED])} THEN 'exact_secret' WHEN {has('buffer', WORDS)} THEN 'restricted_token' WHEN {has('buffer', [f for v, _ in WATCHED for f in ST.fragments(v)])} THEN 'partial_secret' END AS matched_type FROM b)"


@query("STR1", f"{BUFFER_SQL} SELECT stream_id, seq, matched_type IS NOT NULL AS interrupted, matched_type FROM m")
def str1(spark, d):
    return ST.inspect_chunks(chunked(spark, d), WATCHED, WORDS).select("stream_id", "seq", "interrupted", "matched_type")


@query("STR1_stream", f"{BUFFER_SQL}, f AS (SELECT stream_id, min(seq) FILTER (matched_type IS NOT NULL) AS stop FROM m GROUP BY stream_id) SELECT stream_id::VARCHAR AS stream_id, seq, matched_type IS NOT NULL AS interrupted, matched_type FROM m JOIN f USING (stream_id) WHERE stop IS NULL OR seq <= stop")
def str1_stream(spark, d):
    """The stateful form over the same chunks: up to the interruption it says what the windows say."""
    path = folder(spark, "watched")
    live = spark.readStream.schema(table(spark, d, "conversations").schema).parquet(f"{d}/conversation[s].parquet").filter("role = 'assistant'")  # a pattern, as a plain path must be a folder
    chunks = with_probes(live).select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), words().alias("chunk"), F.lit(False).alias("done"))
    to = ST.monitor_stream(chunks, WATCHED, WORDS).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    to.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("stream_id string, seq long, interrupted boolean, matched_type string").parquet(f"{path}/out")


@query("STR2", f"{BUFFER_SQL} SELECT stream_id, arg_max(matched_type, seq) FILTER (seq = mx) AS at_end FROM (SELECT *, max(seq) OVER (PARTITION BY stream_id) AS mx FROM m) GROUP BY stream_id")
def str2(spark, d):
    x = ST.inspect_chunks(chunked(spark, d), WATCHED, WORDS)
    return x.groupBy("stream_id").agg(F.max(F.struct("seq", "matched_type"))["matched_type"].alias("at_end"))


@query("STR3", f"{BUFFER_SQL} SELECT stream_id, bool_or(matched_type IS NOT NULL) AS interrupted, min(seq) FILTER (matched_type IS NOT NULL) AS stopped_at, CASE WHEN bool_or(matched_type IS NOT NULL) THEN {quoted(V.INTERRUPTED)} ELSE string_agg(text, '' ORDER BY seq) END AS response FROM m GROUP BY stream_id")
def str3(spark, d):
    return ST.answers(ST.inspect_chunks(chunked(spark, d), WATCHED, WORDS))


@query("STR4", f"{OUTPUTS}, z AS (SELECT conv_id, turn, lower(right(text, 2000)) AS t FROM c) SELECT conv_id, turn, {has('t', [v.lower() for v, _ in WATCHED])} OR {has('t', WORDS)} OR {has('t', [f for v, _ in WATCHED for f in ST.fragments(v)])} AS blocked FROM z")
def str4(spark, d):
    return ST.check_output(outputs(spark, d), WATCHED, WORDS).select(*ID, "blocked")


# ---- registries of any size -------------------------------------------------------------------------------------


def large_registry(spark, d):
    """Assets of the tables: every part's name and brand with its key, every customer's name, and what lies inside each turn that a user wrote; names of parts
    besides, of which pieces count too."""
    modes = lambda *m: F.array(*map(F.lit, m))
    none = F.array().cast("array<string>")
    one = lambda x, key, value, aliases, protection: x.select(F.concat(F.lit(key), F.lit(":"), *value[0]).alias("asset_id"), F.lit(key).alias("name"), F.lit("exact").alias("type"), value[1].alias("value"), aliases.alias("aliases"), F.lit("high").alias("risk_level"), modes("owner").alias("allowed_roles"), protection.alias("protection_modes"), F.lit(True).alias("enabled"), F.lit("").alias("description"), F.lit("user").alias("source"))
    parts = table(spark, d, "part")
    return (
        one(parts, "part", ([F.col("p_partkey")], F.concat_ws("-", "p_name", F.col("p_partkey").cast("string"))), F.array(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string"))), modes("exact_match"))
        .unionByName(one(parts.select("p_name").distinct(), "name", ([F.col("p_name")], F.col("p_name")), none, modes("exact_match", "partial_match")))
        .unionByName(one(table(spark, d, "customer"), "customer", ([F.col("c_custkey")], F.col("c_name")), none, modes("exact_match")))
        .unionByName(one(table(spark, d, "conversations").filter("role = 'user'"), "turn", ([F.col("conv_id"), F.lit("-"), F.col("turn")], F.expr("substring(text, 6, 12 + turn)")), none, modes("exact_match")))
    )


REGISTRY_SQL = """ra AS (SELECT 'part:' || p_partkey AS asset_id, p_name || '-' || p_partkey AS value, [p_brand || '-' || p_partkey] AS aliases, false AS part FROM part
  UNION ALL SELECT 'name:' || p_name, p_name, []::VARCHAR[], true FROM (SELECT DISTINCT p_name FROM part) UNION ALL SELECT 'customer:' || c_custkey, c_name, []::VARCHAR[], false FROM customer
  UNION ALL SELECT 'turn:' || conv_id || '-' || turn, substr(text, 6, 12 + turn), []::VARCHAR[], false FROM conversations WHERE role = 'user')"""
#: Every text gets the names of a part and of a customer that its place in the table points to, so that there are hits.
NAMED_SQL = """tx AS (SELECT conv_id, turn, text || CASE conv_id % 4 WHEN 0 THEN ' ' || p_name || '-' || p_partkey WHEN 1 THEN ' ' || upper(c_name) WHEN 2 THEN ' ' || p_brand || '-' || p_partkey ELSE '' END AS text
  FROM c JOIN part ON p_partkey = (conv_id * 31 + turn) % (SELECT count(*) FROM part) JOIN customer ON c_custkey = (conv_id * 17 + turn) % (SELECT count(*) FROM customer))"""


def named_texts(spark, d):
    """Names find their texts by small rows of ids; the texts themselves are shuffled once."""
    parts, customers = table(spark, d, "part"), table(spark, d, "customer")
    n, m = parts.count(), customers.count()
    x = turns(spark, d)
    at = x.select(*ID).distinct().withColumns({"p_partkey": (F.col("conv_id") * 31 + F.col("turn")) % n, "c_custkey": (F.col("conv_id") * 17 + F.col("turn")) % m})
    at = at.join(parts.select("p_partkey", "p_name", "p_brand"), "p_partkey").join(customers.select("c_custkey", "c_name"), "c_custkey")
    four = F.col("conv_id") % 4
    more = F.when(four == 0, F.concat(F.lit(" "), "p_name", F.lit("-"), F.col("p_partkey"))).when(four == 1, F.concat(F.lit(" "), F.upper("c_name"))).when(four == 2, F.concat(F.lit(" "), "p_brand", F.lit("-"), F.col("p_partkey"))).otherwise("")
    return x.join(at.select(*ID, more.alias("more")), list(ID)).select(*ID, F.concat("text", "more").alias("text"))


LARGE_HITS = f"""{TURNS}, {REGISTRY_SQL}, {NAMED_SQL}, rh AS (SELECT conv_id, turn, asset_id, CASE WHEN value <> '' AND contains({L}, lower(value)) THEN 'exact' WHEN len(aliases) > 0 AND contains({L}, lower(aliases[1])) THEN 'alias'
  WHEN part AND len(list_filter(range(1, length(value) - 2), lambda i: contains({L}, substr(lower(value), i, 4)))) > 0 THEN 'partial' END AS kind FROM tx, ra)"""


@query("JOIN5_large", f"{LARGE_HITS} SELECT conv_id, turn, asset_id, kind FROM rh WHERE kind IS NOT NULL")
def join5_large(spark, d):
    return IX.hits(named_texts(spark, d), large_registry(spark, d), list(ID)).select(*ID, "asset_id", "kind")


@query("AGG13_large", f"""{LARGE_HITS}, w AS (SELECT conv_id, turn, bool_or(kind IN ('exact', 'alias')) AS whole, bool_or(kind = 'partial') AS part, count(kind) AS n FROM rh GROUP BY ALL),
z AS (SELECT tx.*, whole, part, n, {rx('text', [p[0] for p in V.SECRET_PATTERNS.values() if p[3] == 'BLOCK'])} AS grave, {rx('text', [p[0] for p in V.SECRET_PATTERNS.values() if p[3] == 'REDACT'])} AS plain FROM tx JOIN w ON w.conv_id = tx.conv_id AND w.turn = tx.turn)
SELECT conv_id, turn, n AS assets, CASE WHEN whole OR grave THEN 'BLOCK' WHEN part OR plain THEN 'REDACT' ELSE 'ALLOW' END AS action, CASE WHEN whole OR grave THEN 'CRITICAL_LEAK' WHEN plain THEN 'FULL_LEAK' WHEN part THEN 'PARTIAL_LEAK' ELSE 'NO_LEAK' END AS risk_level FROM z""")
def agg13_large(spark, d):
    return IX.judged(named_texts(spark, d), large_registry(spark, d), list(ID)).select(*ID, "assets", "action", "risk_level")


@query("AGG12_large", f"""{TURNS}, {REGISTRY_SQL}, {NAMED_SQL}, rv AS (SELECT asset_id, value FROM ra WHERE asset_id LIKE 'customer:%'), e AS (SELECT conv_id, turn, count(*) AS n FROM tx, rv WHERE contains({L}, lower(value)) GROUP BY ALL)
SELECT conv_id, turn, true AS is_leak, 'critical' AS highest_severity, 'block' AS recommended_action FROM e""")
def agg12_large(spark, d):
    """Whole leaks of customers' names; under exact_match and encoding_match alone, as pieces of them are in every one."""
    registry = large_registry(spark, d).filter("asset_id LIKE 'customer:%'").withColumn("protection_modes", F.array(F.lit("exact_match"), F.lit("encoding_match")))
    whole = lambda r: IX.leak_needles(r).filter("kind IN ('exact', 'code')")
    return IX.leaking(named_texts(spark, d), registry, list(ID), needles=whole).select(*ID, "is_leak", "highest_severity", "recommended_action")


# ---- watched streams with control -----------------------------------------------------------------------------------

#: What a user says in a turn acts on the stream of the conversation's answers.
CONTROLS = {"pirate": "set", "trust me": "clear", "markdown": "reset", "step by step": "done"}


def controlled(rows):
    """Turns as rows of a watched stream; time goes on by a minute from conversation to conversation."""
    word = F.coalesce(*(F.when(F.col("text").contains(w), F.lit(k)) for w, k in CONTROLS.items()), F.lit("none"))
    kind = F.when(F.col("role") == "assistant", "chunk").otherwise(word)
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 60 + F.col("turn"))
    return with_probes(rows).select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), kind.alias("kind"), words().alias("text"), F.lit("input").alias("stage"), at.alias("ts"))


def watching(spark, d, **options):
    """Runs the watch over all conversations as a stream, to its end; the folder of its results and state."""
    path = folder(spark, "watch")
    live = spark.readStream.schema(table(spark, d, "conversations").schema).parquet(f"{d}/conversation[s].parquet")
    WT.started(WT.watch(controlled(live), WATCHED, WORDS, **options), f"{path}/out", f"{path}/state").awaitTermination()
    return path


CONTROL_SQL = f"""{TURNS}, k AS (SELECT conv_id::VARCHAR AS stream_id, conv_id, turn AS seq, text, CASE WHEN role = 'assistant' THEN 'chunk' {' '.join(f"WHEN contains(text, '{w}') THEN '{c}'" for w, c in CONTROLS.items())} ELSE 'none' END AS kind FROM c),
e AS (SELECT *, coalesce(sum((kind = 'done')::INT) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life, sum((kind = 'reset')::INT) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS part FROM k),
b AS (SELECT *, lower(right(coalesce(string_agg(CASE WHEN kind = 'chunk' THEN text END, '') OVER (PARTITION BY stream_id, life, part ORDER BY seq ROWS UNBOUNDED PRECEDING), ''), 2000)) AS buffer FROM e),
m AS (SELECT *, CASE WHEN kind = 'done' OR (kind = 'chunk' AND text <> '') THEN CASE WHEN {has('buffer', [v.lower() for v, _ in WATCHED])} THEN 'exact_secret' WHEN {has('buffer', WORDS)} THEN 'restricted_token' WHEN {has('buffer', [f for v, _ in WATCHED for f in ST.fragments(v)])} THEN 'partial_secret' END END AS hit FROM b),
g AS (SELECT *, CASE WHEN kind = 'set' THEN 1 WHEN kind IN ('clear', 'done') THEN 0 WHEN hit IS NOT NULL THEN 1 END AS chg, CASE WHEN kind = 'set' THEN text WHEN kind IN ('clear', 'done') THEN '' ELSE {case('hit', WT.REASONS)} END AS why FROM m),
f AS (SELECT *, coalesce(last_value(chg IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM g)"""


@query("STR1_watch", f"{CONTROL_SQL} SELECT stream_id, seq, hit IS NOT NULL AS interrupted, hit AS matched_type FROM f WHERE kind IN ('chunk', 'done') AND was = 0")
def str1_watch(spark, d):
    """What the stateful watch emits of all conversations, with what users say as control."""
    path = watching(spark, d, idle_ms=10**12)
    return spark.read.schema(WT.OUTPUT).parquet(f"{path}/out").select("stream_id", "seq", "interrupted", "matched_type")


@query("STR2_flags", f"""{CONTROL_SQL} SELECT stream_id, coalesce(arg_max(chg, seq) FILTER (chg IS NOT NULL), 0) = 1 AS interrupted, coalesce(arg_max(why, seq) FILTER (chg IS NOT NULL), '') AS reason,
  CASE WHEN coalesce(arg_max(chg, seq) FILTER (chg IS NOT NULL), 0) = 0 THEN '' WHEN arg_max(kind, seq) FILTER (chg IS NOT NULL) = 'set' THEN 'input' ELSE '{WT.STAGE}' END AS stage FROM f GROUP BY stream_id HAVING arg_max(kind, seq) <> 'done'""")
def str2_flags(spark, d):
    """Flags as the state store has them: set, cleared, and why."""
    return WT.flags(spark, f"{watching(spark, d, idle_ms=10**12)}/state")


@query("STR2_windows", f"{CONTROL_SQL} SELECT stream_id, seq, kind, kind IN ('chunk', 'done') AND was = 0 AS emitted, coalesce(chg, was) = 1 AS flagged FROM f")
def str2_windows(spark, d):
    return WT.watched(controlled(table(spark, d, "conversations")), WATCHED, WORDS).select("stream_id", "seq", "kind", "emitted", "flagged")


IDLE = 630_000


@query("STR1_evicted", f"""{CONTROL_SQL}, l AS (SELECT stream_id, max(conv_id * 60 + seq) AS seen, arg_max(kind, seq) AS kind FROM k GROUP BY stream_id)
SELECT stream_id, kind <> 'done' AND 1000 * seen + {IDLE} > 1000 * (max(seen) OVER () - 60) AS held FROM l""")
def str1_evicted(spark, d):
    """Which streams still have state once the watermark has passed all the others."""
    path = watching(spark, d, idle_ms=IDLE)
    every = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("stream_id")).distinct()
    return every.join(WT.flags(spark, f"{path}/state").select("stream_id", F.lit(True).alias("held")), "stream_id", "left").select("stream_id", F.coalesce("held", F.lit(False)).alias("held"))
