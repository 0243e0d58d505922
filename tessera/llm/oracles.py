"""DuckDB SQL of the operators that SQL can express, over the whole tables, by plain versions of their contracts.

The texts assume that doc_id is unique, as it is in `documents`. They differ in method from the operators: every window, line and
shingle is written out, which suits the sizes of a check and no larger.
"""

from __future__ import annotations

# The reflected polynomial of CRC-32, the multiplier of jump hashing.
_CRC_POLYNOMIAL = 0xEDB88320
_JUMP = 2862933555777941757


def _crc_table() -> list[int]:
    """The 256 remainders of one byte."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (_CRC_POLYNOMIAL if byte & 1 else 0)
        out.append(byte)
    return out


def _bytes(text: str) -> str:
    """SQL for the list of a text's UTF-8 bytes."""
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"


def _crc(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text."""
    step = f"xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_bytes(text)}), lambda c, b: {step}), 4294967295::BIGINT)"


SHARDS = f"""
WITH RECURSIVE jump(doc_id, state, place, shard, grown) AS (
    SELECT doc_id, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END)::UHUGEINT, 0::BIGINT, 0::BIGINT, 0::BIGINT
    FROM documents
    UNION ALL
    SELECT doc_id, next, j, CASE WHEN j < 40 THEN j ELSE shard END, CASE WHEN j < 41 THEN j ELSE grown END
    FROM (SELECT *, floor((place + 1)::DOUBLE * (2147483648.0::DOUBLE / ((next >> 33) + 1)::DOUBLE))::BIGINT AS j
          FROM (SELECT *, (state * {_JUMP}::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS next FROM jump WHERE place < 41))
),
placed AS (SELECT doc_id, max_by(shard, place)::INT AS shard, max_by(grown, place)::INT AS grown_shard FROM jump GROUP BY doc_id),
digests AS (
    SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size,
           CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {_crc("text")} END::BIGINT AS text_crc32
    FROM documents
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY (doc_id % 64 + text_crc32) % 64, doc_id) - 1 AS slot, grown_shard
FROM digests JOIN placed USING (doc_id)
"""

REPEATS = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
blocks AS (
    SELECT doc_id, base, substr(h, 2 * base + 1, 2 * 611) AS part
    FROM (SELECT doc_id, h, unnest(range(0, n - 99, 512)) AS base FROM texts WHERE n >= 100)
),
windows AS MATERIALIZED (
    SELECT doc_id, base + s AS s, md5_number(substr(part, 2 * s + 1, 200)) AS k
    FROM (SELECT doc_id, base, part, unnest(range(length(part) // 2 - 99)) AS s FROM blocks)
),
firsts AS (SELECT k, min((doc_id, s)) AS place FROM windows GROUP BY k HAVING count(*) > 1),
later AS (SELECT doc_id, s FROM windows JOIN firsts USING (k) WHERE (doc_id, s) <> place),
marked AS (SELECT doc_id, s, coalesce(s > 100 + lag(s) OVER (PARTITION BY doc_id ORDER BY s), true) AS opens FROM later),
numbered AS (SELECT doc_id, s, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
runs AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM numbered GROUP BY doc_id, run),
pieces AS (
    SELECT doc_id, a, b, substr(h, 2 * from_ + 1, 2 * (a - from_)) AS piece
    FROM (SELECT runs.*, h, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM runs JOIN texts USING (doc_id))
),
cut AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS removed, count(*) AS spans FROM pieces GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""


def _either(word: str) -> str:
    """An expression for a word with ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = rf"""({_WORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: str, order: int, pattern: str, group: int, keep: str) -> str:
    """SELECT of the spans of one kind: pieces between matches add up to their places."""
    return f"""
    SELECT doc_id, '{kind}' AS kind, {order} AS o, a, a + length(m) AS b FROM (
        SELECT doc_id, m, v, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS a FROM (
            SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v, unnest(ps[:len(ms)]) AS p, generate_subscripts(ms, 1) AS i FROM (
                SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS vs, string_split_regex(text, '{pattern}') AS ps
                FROM documents)))
    WHERE {keep}"""


_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_CHECKED = f"length(v) = 36 AND substr(v, 31) = (SELECT string_agg(substr('{_DIGITS}', ((c // 62 ** k::INT) % 62)::INT + 1, 1), '' ORDER BY k DESC) FROM (SELECT {_crc('substr(v, 1, 30)')} AS c), range(6) AS t(k))"

SECRETS = f"""
WITH spans AS ({
    " UNION ALL ".join((
        _matches("assign", 0, _ASSIGN, 2, "length(v) >= 12"),
        _matches("access", 1, "AKIA[A-Z0-9]+", 0, "length(m) >= 18"),
        _matches("hex", 2, "[0-9a-f]+", 0, "length(m) >= 16"),
        _matches("github", 3, "gh[pousr]_([A-Za-z0-9]+)", 1, _CHECKED),
        _matches("npm", 4, "npm_([A-Za-z0-9]+)", 1, _CHECKED),
    ))
}),
found AS (
    SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
           string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) FILTER (o < 3) AS base,
           string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) AS spans
    FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN found USING (doc_id)
"""


# The five primes of XXH64.
_P = (None, 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_FULL = (1 << 64) - 1


def _u(value: int) -> str:
    return f"{value}::UHUGEINT"


def _low(product: str) -> str:
    """The low 64 bits of an unsigned 128-bit value."""
    return f"(({product}) & {_u(_FULL)})"


def _turn(value: str, bits: int) -> str:
    """A rotation to the left, which is a product modulo 2**64 - 1 (all ones, which it would make zero, apart)."""
    return f"((({value}) * {_u(1 << bits)}) % {_u(_FULL)})"


def _round(total: str, lane: str) -> str:
    inner = _low(f"{total} + {_low(f'{lane} * {_u(_P[2])}')}")
    return _low(f"{_turn(inner, 31)} * {_u(_P[1])}")


def _lane(start: str, size: int) -> str:
    """The little-endian number of `size` bytes of the hex text h, from byte `start`."""
    return "('0x' || " + " || ".join(f"substr(h, 2 * ({start}) + {2 * k + 1}, 2)" for k in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


def _fold(first: str, steps: str, step: str) -> str:
    return f"list_reduce(list_prepend({first}, {steps}), lambda t, l: {step})"


def _stripes(k: int) -> str:
    """The k-th of four running values over stripes of 32 bytes, seed 42."""
    first = ((42 + _P[1] + _P[2]) & _FULL, (42 + _P[2]) & _FULL, 42, (42 - _P[1]) & _FULL)[k]
    lanes = f"list_transform(range(n // 32), lambda i: {_lane(f'32 * i + {8 * k}', 8)})"
    return f"CASE WHEN n < 32 THEN {_u(0)} ELSE {_fold(_u(first), lanes, _round('t', 'l'))} END AS v{k}"


def _merged(total: str, k: int) -> str:
    mixed = f"xor({total}, {_round(_u(0), f'v{k}')})"
    return _low(f"{_low(f'{mixed} * {_u(_P[1])}')} + {_u(_P[4])}")


def _xxh64(source: str) -> str:
    """SELECT of shingle and its XXH64 from a relation with distinct shingles."""
    start = _low(" + ".join(_turn(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))))
    for k in range(4):
        start = _merged(start, k)
    eight = f"list_transform(range(n % 32 // 8), lambda i: {_lane('n // 32 * 32 + 8 * i', 8)})"
    turned = _turn(f"xor(t, {_round(_u(0), 'l')})", 27)
    by_eight = _fold("total", eight, _low(f"{_low(f'{turned} * {_u(_P[1])}')} + {_u(_P[4])}"))
    turned = _turn(f"xor(total, {_low(f'{_lane('n // 8 * 8', 4)} * {_u(_P[1])}')})", 23)
    by_four = f"CASE WHEN n % 8 < 4 THEN total ELSE {_low(f'{_low(f"{turned} * {_u(_P[2])}")} + {_u(_P[3])}')} END"
    ones = f"list_transform(range(n % 4), lambda i: {_lane('n // 4 * 4 + i', 1)})"
    turned = _turn(f"xor(t, {_low(f'l * {_u(_P[5])}')})", 11)
    by_one = _fold("total", ones, _low(f"{turned} * {_u(_P[1])}"))
    step = lambda value, shift, prime: _low(f"xor({value}, {value} >> {shift}) * {_u(prime)}")
    return f"""
    SELECT shingle, xor(total, total >> 32)::UBIGINT AS x FROM (SELECT shingle, {step("total", 29, _P[3])} AS total FROM (
    SELECT shingle, {step("total", 33, _P[2])} AS total FROM (SELECT shingle, {by_one} AS total, h, n FROM (
    SELECT shingle, {by_four} AS total, h, n FROM (SELECT shingle, {by_eight} AS total, h, n FROM (
    SELECT shingle, {_low(f"CASE WHEN n < 32 THEN {_u((42 + _P[5]) & _FULL)} ELSE {start} END + n::UHUGEINT")} AS total, h, n FROM (
    SELECT shingle, h, n, {", ".join(map(_stripes, range(4)))} FROM (
    SELECT shingle, hex(encode(shingle)) AS h, strlen(shingle) AS n FROM {source}))))))))"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x20\x09-\x0D]+"

NEAR_DUPLICATES = f"""
WITH RECURSIVE lists AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS w FROM documents),
shingles AS MATERIALIZED (
    SELECT doc_id, array_to_string(w[i : i + 2], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM lists WHERE len(w) > 0)
),
hashes AS MATERIALIZED ({_xxh64("(SELECT DISTINCT shingle FROM shingles)")}),
votes AS (
    SELECT doc_id, count(*) AS n, {", ".join(f"sum(((x >> {b}) & 1)::BIGINT) AS b{b}" for b in range(64))}
    FROM shingles JOIN hashes USING (shingle) GROUP BY doc_id
),
prints AS MATERIALIZED (
    SELECT doc_id, coalesce({" + ".join(f"CASE WHEN 2 * b{b} > n THEN {_u(1 << b)} ELSE {_u(0)} END" for b in range(64))}, {_u(0)})::UBIGINT AS fp
    FROM documents LEFT JOIN votes USING (doc_id)
),
kinds AS MATERIALIZED (SELECT fp, min(doc_id) AS low FROM prints GROUP BY fp),
links AS MATERIALIZED (SELECT a.fp AS u, b.fp AS v FROM kinds a JOIN kinds b ON bit_count(xor(a.fp, b.fp)::BIT) <= 3),
reach AS (SELECT fp, fp AS other FROM kinds UNION SELECT reach.fp, links.v FROM reach JOIN links ON links.u = reach.other),
lowest AS (SELECT reach.fp, min(kinds.low) AS component_id FROM reach JOIN kinds ON kinds.fp = reach.other GROUP BY reach.fp)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM prints JOIN lowest USING (fp)
"""

QUALITY = f"""
WITH lists AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS often
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM lists WHERE len(w) > 2)
),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM windows, range(3) AS t(k) WHERE often > 1 GROUP BY doc_id),
base AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(filled) - len(list_distinct(filled)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS filled FROM lists) LEFT JOIN repeated USING (doc_id)
),
places AS (
    SELECT doc_id, unnest(bytes) AS b, generate_subscripts(bytes, 1) AS i FROM (SELECT doc_id, {_bytes("text")} AS bytes FROM lists)
),
grams AS MATERIALIZED (
    SELECT doc_id, (((b + b1 * 256 + b2 * 65536 + b3 * 16777216)::UBIGINT * {0x9E3779B1}::UBIGINT) % 4294967296::UBIGINT // 65536::UBIGINT)::INT AS g FROM (
        SELECT doc_id, b, lead(b, 1) OVER d AS b1, lead(b, 2) OVER d AS b2, lead(b, 3) OVER d AS b3 FROM places WINDOW d AS (PARTITION BY doc_id ORDER BY i))
    WHERE b3 IS NOT NULL
),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
counts AS (SELECT g, count(*) AS raw, count(trusted.doc_id) AS good FROM grams LEFT JOIN trusted USING (doc_id) GROUP BY g),
priors AS (SELECT g, good, (raw + 0.5::DOUBLE) / (sum(raw) OVER () + 32768.0::DOUBLE) AS prior, sum(good) OVER () AS goods FROM counts),
weights AS (SELECT g, CASE WHEN goods = 0 THEN 0 ELSE ln((good + 3276.8::DOUBLE * prior) / (goods + 3276.8::DOUBLE) / prior) END AS weight FROM priors),
scores AS (SELECT doc_id, sum(weight) / count(*) AS llr FROM grams JOIN weights USING (g) GROUP BY doc_id)
SELECT * EXCLUDE (llr_), NOT base_failed AND llr_ >= -0.35 AS kept, round(llr_, 6) AS llr FROM (
    SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(llr, 0.0::DOUBLE) AS llr_ FROM base LEFT JOIN scores USING (doc_id))
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by the name of its query."""
    return {
        "op1_jump_sharding": SHARDS,
        "op3_simhash_near_duplicates": NEAR_DUPLICATES,
        "op5_suffix_dedup": REPEATS,
        "op6_quality_rules": QUALITY,
        "op9_secret_scan": SECRETS,
    }
