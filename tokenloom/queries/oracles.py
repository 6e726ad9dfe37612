"""The registered queries once more, as DuckDB SQL.

Where the Spark side works on arrays inside a row, these work on token rows
with window functions; both must agree value for value.
"""

from __future__ import annotations

from ..functions import lexicon as L

_BLANK = r"[ \t\x0B\f\r\x1c-\x1f\x{85}\p{Z}]"
_DIGITS = r"\p{Nd}(?:_?\p{Nd})*"
_NAME = r"[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*"
_RX = "|".join(
    [
        r'(?s:""".*?""")',
        r"(?s:'''.*?''')",
        r'"[^"\\\n]*(?:\\(?s:.)[^"\\\n]*)*"',
        r"'[^'\\\n]*(?:\\(?s:.)[^'\\\n]*)*'",
        r"#[^\n]*",
        r"\n",
        _BLANK + "+",
        rf"{_DIGITS}\.(?:{_DIGITS})?(?:[eE][+-]?{_DIGITS})?",
        rf"\.{_DIGITS}(?:[eE][+-]?{_DIGITS})?",
        rf"{_DIGITS}[eE][+-]?{_DIGITS}j?",
        r"0[oO](?:_?[0-7])+",
        r"0[bB](?:_?[01])+",
        r"0[xX](?:_?[0-9a-fA-F])+",
        _DIGITS,
        r"!=|==|<<|>>|:=",
        r"yield from\b",
        rf"@?{_NAME}",
        r"\\\n",
        r"(?s:.)",
    ]
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


def _blank(column: str) -> str:
    return f"regexp_matches({column}, '^{_BLANK}')"


def _at_line_start(before: str, before2: str) -> str:
    ends = lambda c: f"({c} IS NULL OR ends_with({c}, chr(10)))"
    return f"({ends(before)} OR ({_blank(before)} AND {ends(before2)}))"


_TRIPLE = "(length(tok) >= 6 AND (starts_with(tok, '\"\"\"') OR starts_with(tok, '''''''')))"

_WORD = f"""
    CASE WHEN n1[1] IN ('"', '''') AND lower(tok) IN {_list(L.STRING_PREFIXES)}
           THEN '{L.STRING_AFFIX}'
         WHEN p2 = 'class' AND {_blank('p1')} THEN '{L.NAME_CLASS}'
         WHEN p2 = 'def' AND {_blank('p1')} AND tok NOT IN {_list(L.MAGIC_FUNCTIONS)}
           THEN '{L.NAME_FUNCTION}'
         WHEN (p2 = 'from' OR (p2 = 'import' AND {_at_line_start('p3', 'p4')}))
              AND {_blank('p1')} AND tok <> 'None' THEN '{L.NAME_NAMESPACE}'
         WHEN tok IN {_list(L.KEYWORDS)} THEN '{L.KEYWORD}'
         WHEN tok IN {_list(L.KEYWORD_CONSTANTS)} THEN '{L.KEYWORD_CONSTANT}'
         WHEN tok IN {_list(L.OPERATOR_WORDS)} THEN '{L.OPERATOR_WORD}'
         WHEN tok IN {_list(L.MAGIC_FUNCTIONS)} THEN '{L.NAME_FUNCTION_MAGIC}'
         WHEN tok IN {_list(L.MAGIC_VARIABLES)} THEN '{L.NAME_VARIABLE_MAGIC}'
         WHEN tok IN ('def', 'class') AND (n1 = chr(10) OR {_blank('n1')}) THEN '{L.KEYWORD}'
         WHEN tok IN ('from', 'import') AND (n1 = chr(10) OR {_blank('n1')})
           THEN '{L.KEYWORD_NAMESPACE}'
         WHEN p1 = '.' THEN '{L.NAME}'
         WHEN tok IN {_list(L.BUILTINS)} THEN '{L.NAME_BUILTIN}'
         WHEN tok IN {_list(L.PSEUDO_BUILTINS)} THEN '{L.NAME_PSEUDO}'
         WHEN tok IN {_list(L.EXCEPTIONS)} THEN '{L.NAME_EXCEPTION}'
         ELSE '{L.NAME}' END
"""

_TYPE = f"""
    CASE WHEN regexp_matches(tok, '^[\\p{{L}}\\p{{Nl}}_]') THEN {_WORD}
         WHEN tok = chr(10) OR {_blank('tok')} OR starts_with(tok, '\\') THEN '{L.TEXT}'
         WHEN starts_with(tok, '#!') AND i = 0 THEN '{L.HASHBANG}'
         WHEN starts_with(tok, '#') THEN '{L.COMMENT}'
         WHEN {_TRIPLE} AND ({_at_line_start('p1', 'p2')} OR
              (coalesce(lower(p1), '') IN {_list(L.DOCSTRING_PREFIXES)}
               AND {_at_line_start('p2', 'p3')})) THEN '{L.DOCSTRING}'
         WHEN starts_with(tok, '"') AND length(tok) > 1 THEN '{L.STRING_DOUBLE}'
         WHEN starts_with(tok, '''') AND length(tok) > 1 THEN '{L.STRING_SINGLE}'
         WHEN starts_with(tok, '@') AND length(tok) > 1 THEN '{L.NAME_DECORATOR}'
         WHEN regexp_matches(tok, '^0[xX]') THEN '{L.HEX}'
         WHEN regexp_matches(tok, '^0[oO]') THEN '{L.OCT}'
         WHEN regexp_matches(tok, '^0[bB]') THEN '{L.BIN}'
         WHEN regexp_matches(tok, '^\\.?\\p{{Nd}}.*[.eE]') OR regexp_matches(tok, '^\\.\\p{{Nd}}')
           THEN '{L.FLOAT}'
         WHEN regexp_matches(tok, '^\\p{{Nd}}') THEN '{L.INTEGER}'
         WHEN tok IN {_list(L.OPERATOR_CHARS + L.OPERATOR_PAIRS)} THEN '{L.OPERATOR}'
         WHEN tok IN {_list(L.PUNCTUATION_CHARS)} THEN '{L.PUNCTUATION}'
         ELSE '{L.ERROR}' END
"""


def _raw(source: str, prefix: str = "") -> str:
    """CTEs up to ``{prefix}typed(doc_id, i, tok, t_type)``."""
    return f"""
{prefix}src AS ({source}),
{prefix}norm AS (
  SELECT doc_id, trim(regexp_replace(regexp_replace(text, '^\\x{{FEFF}}', ''),
         '\\r\\n?', chr(10), 'g'), chr(10)) || chr(10) AS text FROM {prefix}src),
{prefix}split AS (SELECT doc_id, regexp_extract_all(text, {_text(_RX)}) AS toks FROM {prefix}norm),
{prefix}raw AS (
  SELECT doc_id, u.nr - 1 AS i, u.tok
  FROM {prefix}split, unnest(toks) WITH ORDINALITY AS u(tok, nr)),
{prefix}near AS (
  SELECT doc_id, i, tok, lag(tok, 1) OVER w AS p1, lag(tok, 2) OVER w AS p2,
         lag(tok, 3) OVER w AS p3, lag(tok, 4) OVER w AS p4, lead(tok) OVER w AS n1
  FROM {prefix}raw WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
{prefix}typed AS (SELECT doc_id, i, tok, {_TYPE} AS t_type FROM {prefix}near)"""


def _tokens(source: str, prefix: str = "", trim: bool = True) -> str:
    """CTEs up to ``{prefix}tokens(doc_id, pos, t_type, token)``."""
    strings = _list([L.STRING_SINGLE, L.STRING_DOUBLE])
    kept = "max(token <> '<|endofline|>') OVER (PARTITION BY doc_id ORDER BY i, j)"
    return f"""{_raw(source, prefix)},
{prefix}normal AS (
  SELECT doc_id, i, t_type,
         CASE WHEN t_type IN {strings} AND {_TRIPLE} THEN substr(tok, 4, length(tok) - 6)
              WHEN t_type IN {strings} THEN substr(tok, 2, length(tok) - 2)
              WHEN tok = chr(10) THEN '<|endofline|>'
              WHEN t_type = '{L.TEXT}' AND NOT starts_with(tok, '\\')
                THEN CASE WHEN length(tok) % 4 = 0 THEN '<|tab|>' ELSE '<|space|>' END
              ELSE tok END AS token,
         CASE WHEN t_type = '{L.TEXT}' AND NOT starts_with(tok, '\\') AND length(tok) % 4 = 0
              THEN length(tok) // 4 ELSE 1 END AS copies
  FROM {prefix}typed WHERE t_type NOT IN {_list(L.EXCLUDED_TYPES)}),
{prefix}spread AS (
  SELECT doc_id, i, u.j, t_type, token FROM {prefix}normal, unnest(range(copies)) AS u(j)),
{prefix}flagged AS (SELECT *, {kept if trim else 'true'} AS keep FROM {prefix}spread),
{prefix}tokens AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS pos,
         t_type, token
  FROM {prefix}flagged WHERE keep)"""


_DOCS = "SELECT doc_id, text FROM documents"
_PAGES = "SELECT page_id AS doc_id, html AS text FROM pages"
_TURNS = "SELECT conv_id || '-' || turn AS doc_id, text FROM conversations"
_DOC_TOKENS = _tokens(_DOCS)
_OPEN = _list(L.OPEN_CLASS_TYPES)

_FREQ = f"""{_DOC_TOKENS},
freq AS (
  SELECT t_type, token, count(*) AS count,
         min(doc_id::HUGEINT * 2147483648 + pos) AS first_seen
  FROM tokens GROUP BY t_type, token)"""

_KEY = "'|' || t_type || '|_' || token"


def _vocab(threshold: int = L.FREQUENCY_THRESHOLD) -> str:
    return f"""{_FREQ},
reserved AS (
  SELECT 0 AS id, NULL::VARCHAR AS t_type, '<|start|>' AS token, '<|start|>' AS key, 0::BIGINT AS count
  UNION ALL
  SELECT row_number() OVER (ORDER BY u.t)::INT, u.t, '<|unknown|>', '|' || u.t || '|_<|unknown|>', 0
  FROM unnest([{_OPEN[1:-1]}]) AS u(t)),
vocab AS (
  SELECT id, t_type, token, key, count FROM reserved
  UNION ALL
  SELECT (14 + row_number() OVER (ORDER BY first_seen))::INT, t_type, token, {_KEY}, count
  FROM freq WHERE (count > {threshold} OR t_type NOT IN {_OPEN})
    AND NOT (token = '<|unknown|>' AND t_type IN {_OPEN}))"""


def _coded(prefix: str = "") -> str:
    return f"""
{prefix}coded AS (
  SELECT k.doc_id, k.pos, k.t_type, k.token, coalesce(v.id, r.id) AS id
  FROM {prefix}tokens k
  LEFT JOIN (SELECT * FROM vocab WHERE id > 14) v ON v.t_type = k.t_type AND v.token = k.token
  LEFT JOIN (SELECT * FROM vocab WHERE id BETWEEN 1 AND 14) r ON r.t_type = k.t_type),
{prefix}listed AS (
  SELECT s.doc_id, [0] || coalesce(list(c.id ORDER BY c.pos) FILTER (c.pos IS NOT NULL), []) AS ids
  FROM {prefix}src s LEFT JOIN {prefix}coded c ON c.doc_id = s.doc_id GROUP BY s.doc_id)"""


_ENCODED = f"{_vocab()},{_coded()},\nencoded AS (SELECT * FROM listed WHERE len(ids) >= 10)"


def _chunks(n_ctx: int = L.N_CTX) -> str:
    return f"""{_ENCODED},
chunks AS (
  SELECT doc_id, u.j::INT AS chunk_no, ids[u.j * {n_ctx} + 1 : (u.j + 1) * {n_ctx}] AS chunk
  FROM encoded, unnest(range((len(ids) + {n_ctx} - 1) // {n_ctx})) AS u(j))"""


def _text_of(array: str) -> str:
    return f"coalesce(array_to_string({array}, ','), '')"


_BATCHES = f"""{_chunks()},
placed AS (
  SELECT *, row_number() OVER (ORDER BY md5('0-0-' || doc_id || '-' || chunk_no)) - 1 AS place
  FROM chunks),
batches AS (
  SELECT place // 8 AS batch_id, (place % 8)::INT AS row_in_batch, doc_id, chunk_no,
         chunk[:-2] AS x, chunk[2:] AS y,
         max(len(chunk) - 1) OVER (PARTITION BY place // 8)::INT AS width
  FROM placed),
padded AS (
  SELECT batch_id, row_in_batch, width, doc_id, chunk_no,
         list_resize(x, width, 0) AS x, list_resize(y, width, 0) AS y FROM batches)"""



def _digits_moved() -> str:
    """One move of ``v`` through the rounds: both digits in turn, each by the other one."""
    rows = "SELECT *, v // low AS l0, v % low AS r0 FROM walk JOIN dims USING (epoch) WHERE moves = 0 OR v >= n"
    for i in range(4):
        key = f"('0x' || md5('3-' || epoch || '-{i}')[:7])::BIGINT"
        for new, old, other, radix in ((f"l{i + 1}", f"l{i}", f"r{i}", "high"), (f"r{i + 1}", f"r{i}", f"l{i + 1}", "low")):
            by = f"(({other} * 48271 + {key}) % 2147483647 * 69621 + {key}) % 2147483629"
            rows = f"SELECT *, ({old} + {by}) % {radix} AS {new} FROM ({rows})"
    return f"SELECT doc_id, chunk_no, chunk, epoch, l4 * low + r4, moves + 1 FROM ({rows})"


_EPOCHS = f"""RECURSIVE {_chunks()},
dims AS (
  SELECT epoch, n, high, ((n + high - 1) // high)::BIGINT AS low
  FROM (SELECT count(*)::BIGINT AS n, ceil(sqrt(count(*)))::BIGINT AS high FROM chunks),
       (VALUES (0), (1)) AS e(epoch)),
walk AS (
  SELECT doc_id, chunk_no, chunk, epoch, (row_number() OVER (PARTITION BY epoch ORDER BY doc_id, chunk_no) - 1)::BIGINT AS v,
         0 AS moves
  FROM chunks, dims
  UNION ALL
  {_digits_moved()}),
batches AS (
  SELECT epoch, v // 8 AS batch_id, (v % 8)::INT AS row_in_batch, doc_id, chunk_no, chunk[:-2] AS x, chunk[2:] AS y,
         max(len(chunk) - 1) OVER (PARTITION BY epoch, v // 8)::INT AS width
  FROM walk JOIN dims USING (epoch) WHERE moves > 0 AND v < n),
padded AS (
  SELECT epoch, batch_id, row_in_batch, width, doc_id, chunk_no,
         list_resize(x, width, 0) AS x, list_resize(y, width, 0) AS y FROM batches)"""

_PIECE = f"""CASE WHEN id = 0 THEN ''
     WHEN t_type = '{L.TEXT}' AND token = '<|endofline|>' THEN chr(10)
     WHEN t_type = '{L.TEXT}' AND token = '<|space|>' THEN ' '
     WHEN t_type = '{L.TEXT}' AND token = '<|tab|>' THEN '    '
     WHEN contains(t_type, 'String') THEN '''' || token || ''''
     ELSE token END"""

_LISTING = """
listing AS (
  SELECT doc_id, lang AS user, source AS repo,
    source || '-main/' ||
    ['', 'src/', 'tests/', 'src/testing/', 'unittests/', 'src/core/', 'testdata/x/'][doc_id % 7 + 1] ||
    coalesce(['__init__.py', 'test_a.py', 'tests.py', 'conftest.py', 'a_test.py', 'setup.cfg',
              'A.PY'][doc_id % 11 + 1], 'mod_' || (doc_id % 50) || '.py') AS path
  FROM documents)"""
_BASE = "split_part(path, '/', -1)"
_INNER = "substr(path, strpos(path, '/') + 1)"
_NAME_OK = rf"NOT regexp_matches({_BASE}, '^(__init__\.py|test_.+\.py)')"
_DIR_OK = rf"NOT regexp_matches({_INNER}, '(^|/)test[^/]*/')"

_SCORES = """
scores AS (
  SELECT vec_id, embedding AS logits, label % len(embedding) AS target,
         vec_id // 8 AS batch, (vec_id // 8) % 5 AS epoch FROM embeddings),
judged AS (
  SELECT vec_id, batch, epoch, target,
         ln(list_sum(list_transform(logits, lambda v: exp(v::DOUBLE - list_max(logits)::DOUBLE))))
         + list_max(logits)::DOUBLE - logits[target + 1]::DOUBLE AS loss,
         (list_position(logits, list_max(logits)) - 1 = target)::INT AS hit
  FROM scores),
batch_scores AS (
  SELECT epoch, batch, sum(loss) FILTER (target <> 0) / nullif(count(*) FILTER (target <> 0), 0) AS loss,
         count(*) FILTER (target <> 0) AS n_targets, avg(hit) AS accuracy,
         avg(hit) FILTER (target <> 0) AS masked_accuracy
  FROM judged GROUP BY epoch, batch)"""

_RANKED_SCORES = """
ranked AS (
  SELECT vec_id, (nr - 1)::INT AS id, score::DOUBLE AS score,
         row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, nr) AS rank
  FROM (SELECT vec_id, u.score, u.nr
        FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(score, nr)))"""


def _pairs() -> str:
    return f"""{_chunks()},
pairs AS (
  SELECT doc_id, chunk_no, u.nr, u.a AS a, chunk[u.nr - 1] AS before, chunk[u.nr - 2] AS before2,
         chunk[u.nr + 1] AS target
  FROM chunks, unnest(chunk) WITH ORDINALITY AS u(a, nr) WHERE u.nr < len(chunk)),
counts0 AS (SELECT '' AS context, target, count(*) AS n FROM pairs GROUP BY ALL),
counts1 AS (SELECT a::VARCHAR AS context, target, count(*) AS n FROM pairs GROUP BY ALL),
counts2 AS (SELECT before || ',' || a AS context, target, count(*) AS n
            FROM pairs WHERE nr > 1 GROUP BY ALL),
counts3 AS (SELECT before2 || ',' || before || ',' || a AS context, target, count(*) AS n
            FROM pairs WHERE nr > 2 GROUP BY ALL)"""


def _chosen(ranked: str, key: str) -> str:
    """CTE ``chosen(key, choice, id, piece)`` from ``ranked(key, rank, id)``."""
    return f"""
pieces AS (
  SELECT r.{key}, r.rank, r.id, {_PIECE.replace('WHEN id', 'WHEN v.id')} AS piece
  FROM {ranked} r JOIN vocab v ON v.id = r.id WHERE r.rank <= 2),
firsts AS (
  SELECT {key}, max(id) FILTER (rank = 1) AS id1, max(piece) FILTER (rank = 1) AS piece1,
         max(id) FILTER (rank = 2) AS id2, max(piece) FILTER (rank = 2) AS piece2
  FROM pieces GROUP BY {key}),
chosen AS (
  SELECT {key}, (piece1 = '<|unknown|>' AND id2 IS NOT NULL)::INT AS choice,
         CASE WHEN piece1 = '<|unknown|>' AND id2 IS NOT NULL THEN id2 ELSE id1 END AS id,
         CASE WHEN piece1 = '<|unknown|>' AND id2 IS NOT NULL THEN piece2 ELSE piece1 END AS piece
  FROM firsts)"""


_PROMPTS = _tokens(_TURNS, "p_") + "," + _coded("p_")


def _choices(k: int) -> str:
    """CTE ``chosen`` over contexts of up to ``k`` ids, and the prompts."""
    counts = " UNION ALL ".join(f"SELECT * FROM counts{j}" for j in range(k + 1))
    return f"""{_pairs()},
ranked_all AS (
  SELECT context, target AS id, row_number() OVER (PARTITION BY context ORDER BY n DESC, target) AS rank
  FROM ({counts})),{_chosen('ranked_all', 'context')},{_PROMPTS}"""


def _endings(ids: str, k: int) -> str:
    """Joins to the choices of the last ``k`` ids, the last ``k - 1``, and so on."""
    return "\n".join(
        f"LEFT JOIN chosen c{j} ON c{j}.context = array_to_string({ids}[-{j}:], ',') AND len({ids}) >= {j}"
        if j else "LEFT JOIN chosen c0 ON c0.context = ''"
        for j in range(k, -1, -1)
    )


def _longest(column: str, k: int) -> str:
    whens = " ".join(f"WHEN c{j}.id IS NOT NULL THEN c{j}.{column}" for j in range(k, -1, -1))
    return f"CASE {whens} END AS {column}"


_QUOTED = r"""
  CASE WHEN contains(token, '''') AND NOT contains(token, '"') THEN '"' || esc || '"'
       ELSE '''' || replace(esc, '''', '\''') || '''' END"""
_RARE = rf"""
rare AS (
  SELECT t_type, token, row_number() OVER (PARTITION BY t_type ORDER BY count DESC, token) AS rank,
         replace(replace(replace(replace(token, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS esc
  FROM freq WHERE count <= 20),
rare_parts AS (
  SELECT t_type, ((rank - 1) // 1000)::INT AS part, string_agg({_QUOTED}, ', ' ORDER BY rank) AS tokens
  FROM rare GROUP BY ALL)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _heldout_backoff() -> str:
    totals = ",\n".join(
        f"""t{j} AS (
  SELECT context, sum(n)::DOUBLE AS total, count(*) AS kinds,
         arg_min(target, -n * 1000000000 + target) AS guess FROM counts{j} GROUP BY context)"""
        for j in range(4)
    )
    chances, lookups = ["1.0 / (SELECT count(*) FROM vocab)"], []
    for j in range(4):
        lookups.append(
            f"LEFT JOIN counts{j} s{j} ON s{j}.context = q.x{j} AND s{j}.target = q.target "
            f"LEFT JOIN t{j} ON t{j}.context = q.x{j}"
        )
        chances.append(
            f"CASE WHEN t{j}.total IS NULL THEN {chances[-1]} ELSE "
            f"(coalesce(s{j}.n, 0) + t{j}.kinds * ({chances[-1]})) / (t{j}.total + t{j}.kinds) END"
        )
    guess = lambda k: "coalesce(" + ", ".join(f"t{j}.guess" for j in range(k, -1, -1)) + ")"
    judged = ", ".join(
        f"-ln({chances[k + 1]}) AS loss{k}, coalesce({guess(k)} = q.target, false)::INT AS hit{k}" for k in (1, 2, 3)
    )
    items = _tokens("SELECT item_id AS doc_id, text FROM benchmark", "b_")
    return _with(
        f"""{_pairs()},{items},{_coded("b_")},
steps AS (
  SELECT doc_id // 8 AS batch, u.c AS a, ids[u.nr + 1] AS target,
         CASE WHEN (u.nr - 1) % {L.N_CTX} >= 1 THEN ids[u.nr - 1] END AS b,
         CASE WHEN (u.nr - 1) % {L.N_CTX} >= 2 THEN ids[u.nr - 2] END AS bb
  FROM b_listed, unnest(ids) WITH ORDINALITY AS u(c, nr)
  WHERE len(ids) >= 2 AND u.nr < len(ids) AND u.nr % {L.N_CTX} <> 0),
asked AS (
  SELECT batch, target, '' AS x0, a::VARCHAR AS x1, b || ',' || a AS x2, bb || ',' || b || ',' || a AS x3 FROM steps),
{totals},
judged AS (SELECT q.batch, q.target, {judged} FROM asked q {" ".join(lookups)})""",
        " UNION ALL ".join(
            f"""SELECT batch, {k} AS k, count(target)::BIGINT AS n_targets,
  count(*) FILTER (target IS NULL)::BIGINT AS n_unknown,
  round(avg(loss{k}) FILTER (target IS NOT NULL), 6) AS loss,
  round(avg(hit{k}) FILTER (target IS NOT NULL), 6) AS accuracy FROM judged GROUP BY batch"""
            for k in (1, 2, 3)
        ),
    )


ORACLES: dict[str, str] = {
    # scans, sources, sinks
    "repo_list": r"""
WITH lines AS (
  SELECT regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '^([^#]*)(#.*)$', '\2\1') AS line
  FROM pages)
SELECT split_part(trim(line), '/', 1) AS user, split_part(trim(line), '/', 2) AS repo
FROM lines
WHERE line NOT LIKE '#%' AND trim(line) <> '' AND length(line) - length(replace(line, '/', '')) = 1""",
    "scan_source_files": "SELECT lang AS user, source AS repo, text FROM documents",
    "utf8_replace": "SELECT doc_id, chr(65533) || chr(65533) || text || chr(65533) AS text FROM documents",
    "unpack_archives": """
SELECT lang AS user, source AS repo, source || '-main/src/doc_' || doc_id || '.py' AS member_path, text
FROM documents""",
    "write_encoded": _with(
        _ENCODED, f"SELECT doc_id, {_text_of('ids')} AS ids, len(ids)::INT AS n_tokens FROM encoded"
    ),
    "read_encoded": _with(
        _ENCODED, f"SELECT doc_id, {_text_of('ids')} AS ids, len(ids)::INT AS n_tokens FROM encoded"
    ),
    "vocab_roundtrip": _with(_vocab(5), "SELECT * FROM vocab"),
    "vocab_report_lines": _with(
        f"{_FREQ},{_RARE}",
        f"""SELECT {_KEY} || ': ' || count AS line FROM freq
UNION ALL SELECT t_type || ' ==> [' || tokens || ']' FROM rare_parts""",
    ),
    "ignored_documents": _with(
        f"{_vocab()},{_coded()}",
        "SELECT doc_id, len(ids)::INT AS n_tokens FROM listed WHERE len(ids) < 10",
    ),
    "run_metadata": _with(
        _vocab(),
        "SELECT count(*)::INT AS n_vocab, 768 AS n_embd, 1024 AS n_ctx, 12 AS n_head, 12 AS n_layer FROM vocab",
    ),
    # filters
    "filter_extension": _with(_LISTING, "SELECT * FROM listing WHERE ends_with(path, '.py')"),
    "filter_basename": _with(_LISTING, f"SELECT * FROM listing WHERE {_NAME_OK}"),
    "prune_test_dirs": _with(_LISTING, f"SELECT * FROM listing WHERE {_DIR_OK}"),
    "select_sources": _with(
        _LISTING,
        f"""
SELECT user, repo, {_BASE} AS basename, path FROM listing
WHERE ends_with(path, '.py') AND {_NAME_OK} AND {_DIR_OK}
QUALIFY row_number() OVER (PARTITION BY user, repo, {_BASE}
  ORDER BY length(path) - length(replace(path, '/', '')) DESC, path DESC) = 1""",
    ),
    "dedup_basename": r"""
WITH bare AS (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS u FROM pages),
paths AS (SELECT split_part(u, '/', 1) AS host, rtrim(substr(u, strpos(u, '/') + 1), '/') AS path FROM bare)
SELECT host, split_part(path, '/', -1) AS basename, path FROM paths
QUALIFY row_number() OVER (PARTITION BY host, split_part(path, '/', -1)
  ORDER BY length(path) - length(replace(path, '/', '')) DESC, path DESC) = 1""",
    "skip_ingested": """
SELECT doc_id, lang, source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "ingest_pages": rf"""
WITH bare AS (
  SELECT page_id, url, md5(html) AS content,
    regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS u FROM pages),
found AS (
  SELECT page_id, content, url LIKE 'http://%' AS plain, split_part(u, '/', 1) AS repo,
    split_part(u, '/', 1) || '/' || rtrim(substr(u, strpos(u, '/') + 1), '/') AS path FROM bare),
taken AS (
  SELECT * FROM found WHERE plain OR repo NOT IN (SELECT repo FROM found WHERE plain)),
winners AS (
  SELECT repo, path FROM taken WHERE {_NAME_OK} AND {_DIR_OK}
  QUALIFY row_number() OVER (PARTITION BY repo, {_BASE}
    ORDER BY length(path) - length(replace(path, '/', '')) DESC, path DESC) = 1)
SELECT regexp_extract(repo, '[^.]+\.[^.]+$') AS user, repo,
  'repositories/' || regexp_extract(repo, '[^.]+\.[^.]+$') || '/' || repo || '/' || {_BASE} AS path,
  page_id, content
FROM taken SEMI JOIN winners USING (repo, path)""",
    "drop_comments": _with(
        _raw(_PAGES),
        f"""SELECT doc_id AS page_id, count(*) AS n_kept, max(i)::INT AS last_pos FROM typed
WHERE t_type NOT IN {_list(L.EXCLUDED_TYPES)} GROUP BY doc_id""",
    ),
    "trim_leading_newlines": _with(
        _tokens(
            "SELECT doc_id, '#!/bin/run' || chr(10) || '# note' || repeat(chr(10), 3) || text AS text"
            " FROM documents"
        ),
        """
SELECT t.doc_id, max(token) FILTER (pos = 0) AS first_token, count(*)::INT AS n_trimmed,
       max(u.n)::INT AS n_untrimmed
FROM tokens t JOIN (SELECT doc_id, count(*) AS n FROM spread GROUP BY doc_id) u USING (doc_id)
GROUP BY t.doc_id""",
    ),
    "min_length_documents": _with(
        f"{_vocab()},{_coded()}",
        "SELECT doc_id, len(ids)::INT AS n_tokens FROM listed WHERE len(ids) >= 10",
    ),
    "vocab_threshold": _with(
        _FREQ, f"SELECT t_type, token, count FROM freq WHERE count > 20 OR t_type NOT IN {_OPEN}"
    ),
    "padding_mask": _with(
        _BATCHES,
        """SELECT batch_id, row_in_batch,
  array_to_string(list_transform(x, lambda v: (v = 0)::INT), '') AS mask FROM padded""",
    ),
    # lexing
    "lex_tokens": _with(
        _raw(_DOCS),
        """SELECT doc_id, count(*)::INT AS n_tokens, string_agg(t_type || '=' || tok, ' ' ORDER BY i) AS tokens
FROM typed GROUP BY doc_id""",
    ),
    "string_literals": _with(
        _tokens(_PAGES),
        f"""SELECT doc_id AS page_id, pos, t_type, token FROM tokens
WHERE t_type IN {_list([L.STRING_SINGLE, L.STRING_DOUBLE])}""",
    ),
    "normalize_whitespace": _with(
        _tokens(_PAGES),
        f"""SELECT doc_id AS page_id, count(*) FILTER (token = '<|endofline|>') AS n_lines,
  count(*) FILTER (token = '<|space|>') AS n_spaces, count(*) FILTER (token = '<|tab|>') AS n_tabs
FROM tokens WHERE t_type = '{L.TEXT}' GROUP BY doc_id""",
    ),
    "token_positions": _with(
        _tokens(_TURNS), "SELECT doc_id AS turn_id, pos, t_type, token FROM tokens"
    ),
    "contextual_types": _with(
        _raw(
            "SELECT doc_id, replace(replace(text, ' the ', ' def '), ' of ', ' class ') AS text FROM documents"
        ),
        "SELECT doc_id, i::INT AS pos, t_type, tok AS token FROM typed WHERE t_type IN "
        + _list(
            [L.NAME_FUNCTION, L.NAME_CLASS, L.NAME_NAMESPACE, L.NAME_DECORATOR,
             L.STRING_AFFIX, L.DOCSTRING, L.COMMENT, L.HASHBANG]
        ),
    ),
    "typed_keys": _with(_FREQ, f"SELECT {_KEY} AS key, count FROM freq"),
    "split_keys": _with(_FREQ, f"SELECT {_KEY} AS key, t_type, token FROM freq"),
    "open_class_tokens": _with(
        _DOC_TOKENS, f"SELECT t_type, token, count(*) AS n FROM tokens WHERE t_type IN {_OPEN} GROUP BY ALL"
    ),
    "path_parts": _with(
        _LISTING,
        f"""SELECT doc_id, split_part(path, '/', 1) AS root, {_INNER} AS inner_path, {_BASE} AS basename,
  (len(string_split(path, '/')) - 1)::INT AS depth,
  'repositories/' || user || '/' || repo || '/' || {_BASE} AS destination FROM listing""",
    ),
    # vocabulary
    "token_frequency": _with(_FREQ, "SELECT t_type, token, count FROM freq"),
    "most_common_tokens": _with(
        _FREQ, "SELECT t_type, token, count FROM freq ORDER BY count DESC, t_type, token"
    ),
    "rare_tokens_by_type": _with(f"{_FREQ},{_RARE}", "SELECT t_type, part, tokens FROM rare_parts"),
    "corpus_stats": _with(
        _LISTING,
        "SELECT count(*) AS n_files, count(*) FILTER (ends_with(path, '.py')) AS n_source_files FROM listing",
    ),
    "build_vocab": _with(_vocab(), "SELECT * FROM vocab"),
    "vocab_ids": _with(_vocab(0), "SELECT id, key FROM vocab"),
    # encoding
    "encode_tokens": _with(
        f"{_vocab()},{_coded()}", "SELECT t_type, id, count(*) AS n FROM coded GROUP BY t_type, id"
    ),
    "encode_documents": _with(
        f"{_vocab()},{_coded()}",
        f"SELECT doc_id, {_text_of('ids')} AS ids, len(ids)::INT AS n_tokens FROM listed",
    ),
    "document_lengths": _with(
        f"{_vocab()},{_coded()}", "SELECT doc_id, len(ids)::INT AS n_tokens FROM listed"
    ),
    "decode_tokens": _with(
        f"{_ENCODED},\nuses AS (SELECT unnest(ids) AS id FROM encoded)",
        f"SELECT v.id, {_PIECE.replace('WHEN id', 'WHEN v.id')} AS piece, count(*) AS n"
        " FROM uses JOIN vocab v ON v.id = uses.id GROUP BY ALL",
    ),
    "decode_documents": _with(
        f"""{_ENCODED},
uses AS (SELECT doc_id, u.id, u.nr FROM encoded, unnest(ids) WITH ORDINALITY AS u(id, nr))""",
        f"SELECT doc_id, string_agg({_PIECE.replace('WHEN id', 'WHEN v.id')}, '' ORDER BY nr) AS text"
        " FROM uses JOIN vocab v ON v.id = uses.id GROUP BY doc_id",
    ),
    # sequences and batches
    "chunk_sequences": _with(
        _chunks(), f"SELECT doc_id, chunk_no, {_text_of('chunk')} AS chunk FROM chunks"
    ),
    "shift_pairs": _with(
        _chunks(100),
        f"""SELECT doc_id, chunk_no, {_text_of('chunk[:-2]')} AS x, {_text_of('chunk[2:]')} AS y
FROM chunks""",
    ),
    "shuffle_sequences": _with(
        _chunks(),
        """SELECT doc_id, chunk_no, len(chunk)::INT AS length,
  md5('7-0-' || doc_id || '-' || chunk_no) AS key,
  row_number() OVER (ORDER BY md5('7-0-' || doc_id || '-' || chunk_no)) - 1 AS place
FROM chunks""",
    ),
    "padded_batches": _with(
        _BATCHES,
        f"""SELECT batch_id, row_in_batch, width, doc_id, chunk_no, {_text_of('x')} AS x,
  {_text_of('y')} AS y FROM padded""",
    ),
    "epoch_batches": _with(
        _EPOCHS,
        f"""SELECT epoch, batch_id, row_in_batch, width, doc_id, chunk_no, {_text_of('x')} AS x,
  {_text_of('y')} AS y FROM padded""",
    ),
    # metrics
    "masked_loss": _with(_SCORES, "SELECT batch, round(loss, 6) AS loss, n_targets FROM batch_scores"),
    "token_accuracy": _with(
        _SCORES,
        """SELECT batch, round(accuracy, 6) AS accuracy, round(masked_accuracy, 6) AS masked_accuracy
FROM batch_scores""",
    ),
    "epoch_metrics": _with(
        _SCORES,
        """SELECT epoch, round(avg(loss), 6) AS loss, round(avg(accuracy), 6) AS accuracy,
  count(*) AS batches FROM batch_scores GROUP BY epoch""",
    ),
    "running_metrics": """
WITH log AS (
  SELECT user_id AS epoch, row_number() OVER w - 1 AS batch, avg(value) OVER w AS loss,
         avg((event_type = 'click')::INT) OVER w AS accuracy
  FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT epoch, batch, round(loss, 4) AS loss, round(accuracy, 4) AS accuracy
FROM log WHERE batch % 10 = 0""",
    "heldout_metrics": _with(
        f"""{_pairs()},{_tokens("SELECT item_id AS doc_id, text FROM benchmark", "b_")},{_coded("b_")},
seen AS (SELECT a AS c, target, count(*) AS n FROM pairs GROUP BY ALL),
best AS (SELECT c, sum(n) AS total, arg_min(target, -n * 1000000000 + target) AS guess FROM seen GROUP BY c),
asked AS (
  SELECT doc_id // 8 AS batch, u.c, ids[u.nr + 1] AS target
  FROM b_listed, unnest(ids) WITH ORDINALITY AS u(c, nr)
  WHERE len(ids) >= 2 AND u.nr < len(ids) AND u.nr % {L.N_CTX} <> 0),
judged AS (
  SELECT batch, target, -ln((coalesce(n, 0) + 1) / (coalesce(total, 0) + (SELECT count(*) FROM vocab))) AS loss,
         coalesce(guess = a.target, false)::INT AS hit
  FROM asked a LEFT JOIN seen s USING (c, target) LEFT JOIN best USING (c))""",
        """SELECT batch, count(target)::BIGINT AS n_targets, count(*) FILTER (target IS NULL)::BIGINT AS n_unknown,
  round(avg(loss) FILTER (target IS NOT NULL), 6) AS loss,
  round(avg(hit) FILTER (target IS NOT NULL), 6) AS accuracy FROM judged GROUP BY batch""",
    ),
    "heldout_backoff": _heldout_backoff(),
    # next-token counts and completion
    "backoff_counts": _with(
        _pairs(), " UNION ALL ".join(f"SELECT context, target, n FROM counts{j}" for j in range(4))
    ),
    "next_token_counts": _with(
        _pairs(),
        """SELECT 1 AS k, context, target, n FROM counts1
UNION ALL SELECT 2, context, target, n FROM counts2""",
    ),
    "top_k_next": _with(
        _pairs(),
        """SELECT context, target, n,
  row_number() OVER (PARTITION BY context ORDER BY n DESC, target)::INT AS rank
FROM counts1 QUALIFY rank <= 10""",
    ),
    "top_k_candidates": _with(
        _RANKED_SCORES, "SELECT vec_id, rank::INT AS rank, id, score FROM ranked WHERE rank <= 10"
    ),
    "choose_candidate": _with(
        f"{_vocab()},{_RANKED_SCORES},{_chosen('ranked', 'vec_id')}",
        "SELECT vec_id, choice, id, piece FROM chosen",
    ),
    "complete_token": _with(
        _choices(2),
        f"""SELECT array_to_string(ids[-2:], ',') AS context, doc_id AS prompt_id,
  {_longest('choice', 2)}, {_longest('id', 2)}, {_longest('piece', 2)}
FROM p_listed {_endings('ids', 2)}""",
    ),
    "complete_line": _with(
        f"""RECURSIVE {_choices(3).lstrip()},
asked AS (SELECT doc_id AS prompt_id, ids[-3:] AS start FROM p_listed),
walk AS (
  SELECT DISTINCT start, start AS context, 0 AS steps, '' AS text, []::INT[][] AS seen,
         NULL::VARCHAR AS status FROM asked
  UNION ALL
  SELECT start, follow, steps + (id IS NOT NULL)::INT, text || coalesce(piece, ''),
         list_append(seen, follow),
         CASE WHEN id IS NULL THEN 'no_candidate'
              WHEN piece = chr(10) AND steps > 0 THEN 'endofline'
              WHEN list_contains(seen, follow) THEN 'cycle' END
  FROM (SELECT *, list_append(context, id)[-3:] AS follow
        FROM (SELECT w.*, {_longest('id', 3)}, {_longest('piece', 3)}
              FROM walk w {_endings('w.context', 3)} WHERE w.status IS NULL)))""",
        """SELECT prompt_id, text AS completion, steps AS n_generated, status
FROM asked JOIN walk USING (start) WHERE status IS NOT NULL""",
    ),
}
ORACLES["stream_encode"] = ORACLES["write_encoded"]
ORACLES["encode_large_vocabulary"] = ORACLES["encode_documents"]
ORACLES["merged_vocab"] = ORACLES["build_vocab"]
ORACLES["stream_ingest_pages"] = ORACLES["ingest_pages"]
