"""DuckDB building blocks: the bound forms as common table expressions, and shared formulas.

They restate the bindings and rules independently of the Spark code, as plain SQL.
"""

from __future__ import annotations

from formpulse import fixed_values as fv
from formpulse.sources.bindings import ANSWERS, SECTORS

Q = fv.QUESTIONS
KEYS = "ano_consolidacao, mes_consolidacao"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def array(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def half_even(x: str, digits: int = 0) -> str:
    """Ties to even, no negative zero."""
    r = f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits})"
    return f"(CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END)"


def percent(x: str, digits: int, fixed: bool = False) -> str:
    text = f"printf('%.{digits}f', {half_even(x, digits)})"
    if digits and not fixed:
        text = f"regexp_replace({text}, '\\.?0+$', '')"
    return f"({text} || '%')"


def r6(x: str) -> str:
    return f"round({x}, 6)"


BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def trim_ws(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def answer(i: int) -> str:
    return (
        f"CASE WHEN (k + {17 * i}) % 151 = 0 THEN NULL WHEN (k + {29 * i}) % 149 = 0 THEN '' "
        f"ELSE {array(ANSWERS)}"
        f"[1 + CAST(((k * {i + 2} + c * {3 * i + 1} + {13 * i}) % 97) % 6 AS INTEGER)] END"
    )


def ordinal(x: str) -> str:
    cases = " ".join(f"WHEN {lit(w)} THEN {i}" for i, w in enumerate(fv.RATING_WORDS, 1))
    return f"CAST(CASE strip_accents(lower({x})) {cases} END AS INTEGER)"


def fifths(x: str) -> str:
    cases = " ".join(f"WHEN {x} = {lit(w)} THEN {i}" for i, w in enumerate(fv.LIKERT_ANSWERS, 1))
    return f"(CASE WHEN {x} IS NULL THEN NULL {cases} ELSE 0 END)"


def score(x: str) -> str:
    return f"CAST({fifths(x)} / 5.0 AS DOUBLE)"


def month_ordinal(x: str) -> str:
    return f"CAST(list_position({array(fv.MONTHS)}, {x}) AS INTEGER)"


def count_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def class_v1(x: str) -> str:
    return f"CASE WHEN {x} <= 6 THEN 'Detrator' WHEN {x} >= 9 THEN 'Promoter' ELSE 'Neutro' END"


def sign(x: str) -> str:
    return f"CAST(CASE WHEN {x} <= 6 THEN -1 WHEN {x} >= 9 THEN 1 ELSE 0 END AS INTEGER)"


def zone_v1(x: str) -> str:
    z = [lit(w) for w in fv.ZONE_LABELS_V1]
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 75 THEN {z[3]} WHEN {x} > 50 THEN {z[2]} "
            f"WHEN {x} > 0 THEN {z[1]} ELSE {z[0]} END")


def zone_v2(x: str) -> str:
    z = [lit(w) for w in fv.ZONE_LABELS_V2]
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} < 0 THEN {z[0]} WHEN {x} < 50 THEN {z[1]} "
            f"WHEN {x} < 75 THEN {z[2]} ELSE {z[3]} END")


_O = f"""o AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, o_orderpriority AS p,
         CASE WHEN o_orderkey % 37 = 0 THEN CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH
              ELSE CAST(o_orderdate AS DATE) END AS cd,
         CAST(nullif(((o_orderkey * 7 + o_custkey * 3) % 97) % 12, 11) AS INTEGER) AS nps
  FROM orders),
f AS (
  SELECT *, CAST(year(cd) AS INTEGER) AS ano_consolidacao,
         CASE WHEN month(cd) = 3 AND k % 5 = 0 THEN 'Marco'
              ELSE {array(fv.MONTHS)}[month(cd)] END AS mes_texto,
         'pessoa ' || c AS nome, 'c-' || c AS contato
  FROM o)"""

_RAW_G = f"""rg AS (
  SELECT k, d, nome, contato, ano_consolidacao, mes_texto, nps,
         d - to_days(CAST(k % 9 AS INTEGER)) AS internacao,
         CASE WHEN k % 43 = 0 THEN NULL ELSE d END AS alta,
         CASE WHEN k % 2 = 0 THEN 'SIM' ELSE 'Não' END AS autorizo,
         CASE WHEN k % 23 = 0 THEN '' WHEN k % 29 = 0 THEN NULL
              ELSE {array(SECTORS)}[1 + CAST(c % 5 AS INTEGER)] END AS setor,
         CASE WHEN k % 4 = 0 THEN ' elogio ' || (c % 50) END AS elogios,
         CASE WHEN k % 4 = 1 THEN ' ' || chr(9) || ' '
              WHEN k % 4 = 2 THEN 'sugestão ' || (c % 50) || ' ' END AS sugestoes,
         CASE WHEN k % 4 = 3 THEN 'reclamação; ' || (c % 50) END AS reclamacoes,
         'equipe ' || (c % 3) AS equipe_pesquisa,
         {", ".join(f"{answer(i)} AS {q}" for i, q in enumerate(Q, 1))}
  FROM f WHERE k % 3 <> 0)"""

_G = f"""g0 AS (
  SELECT k AS id, d AS data, nome, contato, lower(autorizo) AS autorizo, setor,
         CAST(internacao AS DATE) AS data_internacao, CAST(alta AS DATE) AS data_alta,
         elogios, sugestoes, reclamacoes, equipe_pesquisa, nps, ano_consolidacao,
         CASE WHEN mes_texto IN {tuple(fv.MONTHS)} THEN mes_texto END AS mes_consolidacao,
         {month_ordinal("mes_texto")} AS mes_ordinal,
         CAST(year(d) AS INTEGER) AS ano, CAST(month(d) AS INTEGER) AS mes,
         {", ".join(f"{ordinal(q)} AS {q}" for q in Q)}
  FROM rg),
g1 AS (
  SELECT *, {", ".join(
      f"list_avg([{', '.join(f'{b}_{i}' for i in range(1, n + 1))}]) AS m_{b}"
      for b, n in fv.BLOCK_SIZES.items())}
  FROM g0),
g AS (SELECT *, list_avg([{", ".join(f"m_{b}" for b in fv.BLOCK_SIZES)}]) AS m_x FROM g1)"""

_RAW_A = f"""ra AS (
  SELECT k, d, nome, contato, ano_consolidacao, mes_texto, nps,
         {answer(1)} AS recepcao, {answer(2)} AS medico,
         CASE WHEN k % 5 = 0 THEN 'elogio ' || (c % 50) END AS elogios,
         CASE WHEN k % 5 = 1 THEN 'sugestão ' || (c % 50) END AS sugestoes,
         CASE WHEN k % 5 = 2 THEN '' END AS reclamacoes,
         CASE WHEN k % 19 = 0 THEN '' WHEN k % 31 = 0 THEN NULL
              WHEN k % 17 = 0 THEN 'ATT_' || (c % 20) || ' '
              ELSE 'ATT_' || (c % 20) END AS atendente
  FROM f WHERE k % 3 = 0)"""

_A = f"""a0 AS (
  SELECT k AS id, d AS data, nome, contato, elogios, sugestoes, reclamacoes, atendente, nps,
         ano_consolidacao,
         CASE WHEN mes_texto IN {tuple(fv.MONTHS)} THEN mes_texto END AS mes_consolidacao,
         {month_ordinal("mes_texto")} AS mes_ordinal,
         CAST(year(d) AS INTEGER) AS ano, CAST(month(d) AS INTEGER) AS mes,
         {ordinal("recepcao")} AS recepcao, {ordinal("medico")} AS medico
  FROM ra),
a AS (SELECT *, list_avg([recepcao, medico]) AS m FROM a0)"""

_RAW_M = f"""rm AS (
  SELECT k, d, nps,
         '  ' || lower({array(SECTORS)}[1 + CAST(c % 5 AS INTEGER)]) || ' ' AS setor,
         CASE WHEN p IN ('3-MEDIUM', '5-LOW') THEN 'elogio ' || k END AS elogio,
         CASE WHEN p = '2-HIGH' THEN 'sugestão ' || k END AS sugestao,
         CASE WHEN p IN ('1-URGENT', '5-LOW') THEN 'reclamação ' || k END AS reclamacao,
         CASE WHEN k % 7 <> 0 THEN ' maria d''ávila-' || (c % 9) || 'x SOUZA ' END AS nome,
         CASE WHEN k % 11 <> 0 THEN '(62) 0000-' || c END AS telefone,
         CASE WHEN k % 13 <> 0 THEN ' User' || c || '@Example.ORG ' END AS email
  FROM f)"""

TITLE = ("array_to_string(list_transform(regexp_extract_all(trim({x}), '(\\p{{L}}+|\\P{{L}}+)'), "
         "lambda w: upper(w[1]) || lower(w[2:])), '')")
TYPE = ("CASE WHEN elogio IS NOT NULL THEN 'elogio' WHEN sugestao IS NOT NULL THEN 'sugestao' "
        "WHEN reclamacao IS NOT NULL THEN 'reclamacao' ELSE 'preferiu nao informar' END")
CLASS_V2 = "CASE WHEN nps >= 9 THEN 'promotor' WHEN nps >= 7 THEN 'neutro' ELSE 'detrator' END"
FLAG = "CASE WHEN nps >= 9 THEN '🟢' WHEN nps >= 7 THEN '🔵' ELSE '🔴' END"

_M = f"""m AS (
  SELECT strftime(d, '%Y/%m') AS periodo, CAST(d AS DATE) AS dia,
         CAST(year(d) AS INTEGER) AS ano, CAST(month(d) AS INTEGER) AS mes, d AS data,
         upper(trim(setor)) AS setor, nps, {CLASS_V2} AS classe, {FLAG} AS flag, {TYPE} AS tipo,
         coalesce(elogio, sugestao, reclamacao, '-') AS manifestacao,
         coalesce({TITLE.format(x="nome")}, '-') AS nome,
         coalesce(regexp_replace(telefone, '[^0-9]', '', 'g'), '-') AS telefone,
         coalesce(lower(trim(email)), '-') AS email
  FROM rm)"""

_P = """p AS (
  SELECT periodo, setor, count(*) FILTER (WHERE tipo = 'elogio') AS elogio,
         count(*) FILTER (WHERE tipo = 'sugestao') AS sugestao,
         count(*) FILTER (WHERE tipo = 'reclamacao') AS reclamacao,
         count(*) FILTER (WHERE tipo = 'preferiu nao informar') AS preferiu_nao_informar,
         count(*) AS total
  FROM m GROUP BY periodo, setor)"""

_CG = f"""cg AS (
  SELECT 'pessoa ' || (doc_id % 10) AS nome, 'c-' || (doc_id % 10) AS contato,
         CASE WHEN doc_id % 2 = 0 THEN 'sim' ELSE 'não' END AS autorizo,
         {array(fv.COMMENT_KINDS)}[1 + CAST(doc_id % 3 AS INTEGER)] AS kind, text AS texto,
         CAST(2018 + doc_id % 2 AS INTEGER) AS ano_consolidacao,
         {array(fv.MONTHS)}[1 + CAST(doc_id % 4 AS INTEGER)] AS mes_consolidacao
  FROM documents)"""
_CA = f"""ca AS (
  SELECT 'pessoa ' || (conv_id % 10) AS nome, 'c-' || (conv_id % 10) AS contato,
         'Sim' AS autorizo,
         {array(fv.COMMENT_KINDS)}[1 + CAST(conv_id % 3 AS INTEGER)] AS kind,
         CASE WHEN (conv_id + turn) % 9 = 0 THEN ' ' || chr(9) || ' ' ELSE text END AS texto,
         CAST(2018 + conv_id % 2 AS INTEGER) AS ano_consolidacao,
         {array(fv.MONTHS)}[1 + CAST(conv_id % 4 AS INTEGER)] AS mes_consolidacao
  FROM conversations)"""

_N = f"""n AS (
  SELECT ano_consolidacao AS "ANO", mes_consolidacao AS "MES", 'GERAL' AS "ORIGEM", id AS "ID",
         nps AS "NOTA", {class_v1("nps")} AS "CLASSE", {sign("nps")} AS "NPS"
  FROM g WHERE nps IS NOT NULL
  UNION ALL
  SELECT ano_consolidacao, mes_consolidacao, 'AMBULATORIO', id, nps, {class_v1("nps")},
         {sign("nps")}
  FROM a WHERE nps IS NOT NULL)"""


def calendar(first: int, last: int) -> str:
    short, full = array(fv.MONTHS_SHORT), array(fv.MONTHS)
    return f"""cal AS (
  SELECT CAST(y AS INTEGER) AS "ANO", {full}[mo] AS "MES", {short}[mo] AS "MES_CURTO",
         CAST(mo AS INTEGER) AS "MES_ORDINAL", ((mo + 5) // 6) || 'º sim' AS "SEMESTRE",
         y || '.Q' || ((mo + 2) // 3) AS "ID_TRIMESTRE", ((mo + 2) // 3) || 'º tri' AS "TRIMESTRE",
         ((mo + 1) // 2) || 'º bim' AS "BIMESTRE", y || '/' || {full}[mo] AS "PERIODO",
         {short}[mo] || '/' || y AS "PERIODO_CURTO"
  FROM range({first}, {last + 1}) ty(y), range(1, 13) tm(mo))"""


_PARTS = {
    "raw_general": [_O, _RAW_G],
    "general": [_O, _RAW_G, _G],
    "raw_ambulatory": [_O, _RAW_A],
    "ambulatory": [_O, _RAW_A, _A],
    "raw_manifestations": [_O, _RAW_M],
    "manifestations": [_O, _RAW_M, _M],
    "pivot": [_O, _RAW_M, _M, _P],
    "comments": [_CG, _CA],
    "nps_rows": [_O, _RAW_G, _G, _RAW_A, _A, _N],
}


def with_(*names: str, select: str, extra: tuple[str, ...] = ()) -> str:
    """A statement over the named frames, each defined once."""
    parts: list[str] = []
    for name in names:
        parts += [p for p in _PARTS[name] if p not in parts]
    return "WITH " + ",\n".join([*parts, *extra]) + "\n" + select
