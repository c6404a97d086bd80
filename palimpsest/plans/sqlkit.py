"""SQL fragments for the DuckDB checks.  Written for that engine, independent of the Spark code."""

from __future__ import annotations

from palimpsest.functions import patterns as P
from palimpsest.plans.tables import EXTENSIONS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


FULL = "".join(chr(c) for a, b in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)) for c in range(a, b + 1)) + "　"
HALF = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz "


def normal(t: str) -> str:
    return f"translate({t}, {lit(FULL)}, {lit(HALF)})"


def runs(t: str, core: str, underscore: bool = False) -> str:
    """Matches made of letters and digits only are whole runs of them."""
    cls = "[0-9A-Za-z_]+" if underscore else "[0-9A-Za-z]+"
    return f"list_filter(regexp_extract_all({t}, '{cls}'), lambda x: regexp_full_match(x, {lit(core)}))"


def bounded(t: str, core: str, outside: str = "[^0-9A-Za-z]") -> str:
    return f"regexp_extract_all({t}, {lit(f'(?:^|{outside})({core})(?:{outside}|$)')}, 1)"


QUAD = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
DATE = r"(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"
PROV = "京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领"


def iban_ok(x: str) -> str:
    return (
        f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr({x}, 5) || substr({x}, 1, 4), ''), "
        f"lambda c: ord(c)::BIGINT)), lambda a, o: CASE WHEN o >= 65 THEN (a * 100 + o - 55) % 97 ELSE (a * 10 + o - 48) % 97 END) = 1"
    )


def find(kind: str, t: str) -> str:
    """List of valid matches of ``kind`` in text expression ``t``."""
    if kind == "id_card":
        return runs(t, rf"[1-9]\d{{5}}(?:18|19|20)\d{{2}}{DATE}\d{{3}}[\dXx]")
    if kind == "phone":
        return runs(t, r"1[3-9]\d{9}")
    if kind == "bank_card":
        return runs(t, r"\d{16,19}")
    if kind == "passport":
        return runs(t, r"[EGDSH]\d{8}|[a-zA-Z]\d{9}")
    if kind == "ip":
        return bounded(t, rf"(?:{QUAD}\.){{3}}{QUAD}")
    if kind == "email":
        return f"regexp_extract_all({t}, {lit('([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,})(?:[^0-9A-Za-z]|$)')}, 1)"
    if kind == "jwt":
        return bounded(t, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    if kind == "plate":
        return bounded(t, f"[{PROV}][A-Z][A-Z0-9]{{5,6}}")
    if kind == "iban":
        return f"list_filter({runs(t, r'[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}', True)}, lambda x: {iban_ok('x')})"
    if kind == "swift":
        codes = "|".join(P.country_codes())
        return runs(t, f"[A-Z]{{4}}(?:{codes})[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?", True)
    if kind == "vat":
        return runs(t, f"(?:{'|'.join(P.VAT_PREFIXES)})[0-9]{{8,12}}", True)
    if kind == "intl_phone":
        return bounded(t, r"\+[1-9]\d{0,3}[\d\s.\-()]{4,18}\d", "[^0-9A-Za-z_]")
    if kind == "state_secret":
        return f"regexp_extract_all({t}, {lit('密级[[:space:]]*[:：][[:space:]]*(?:机密|绝密|秘密)|[【［(（[][[:space:]]*(?:机密|绝密|秘密)[[:space:]]*[】］)）]]|★{1,3}(?:机密|绝密|秘密)')})"
    if kind == "internal_mark":
        return f"regexp_extract_all({t}, {lit('[【［(（[][[:space:]]*(?:内部资料|内部文件|内部文档|内参)[[:space:]]*[】］)）]]|内部(?:资料|文件|文档|编号)[[:space:]]*[:：]')})"
    raise KeyError(kind)


def keep(x: str, left: int, right: int) -> str:
    return f"(substr({x}, 1, {left}) || repeat('*', length({x}) - {left + right}) || right({x}, {right}))"


def mask(kind: str, x: str) -> str:
    if kind in P.KEEP_RULES:
        _, left, right, _ = P.KEEP_RULES[kind]
        return keep(x, left, right)
    if kind == "email":
        return f"(substr({x}, 1, 1) || '***@' || split_part({x}, '@', 2))"
    if kind == "ip":
        return f"(split_part({x}, '.', 1) || '.' || split_part({x}, '.', 2) || '.*.*')"
    if kind == "jwt":
        return f"(substr({x}, 1, 6) || '***' || right({x}, 6))"
    if kind == "intl_phone":
        digits = f"regexp_replace({x}, '[^0-9]', '', 'g')"
        return f"('+' || repeat('*', length({digits}) - 4) || right({digits}, 4))"
    return lit(P.PLACEHOLDERS[kind])


def pass_ctes(source: str, columns: str, mode: str = "mask") -> str:
    """CTEs s0..s14: normalise, then find and replace kind by kind; ``h_<kind>`` holds the matches."""
    out = [f"s0 AS (SELECT {columns}, {normal('text')} AS t FROM {source})"]
    for i, kind in enumerate(P.KIND_ORDER):
        repl = lit(f"[REDACTED_{kind.upper()}]") if mode == "redact" else mask(kind, "x")
        out.append(f"f{i} AS (SELECT *, {find(kind, 't')} AS h_{kind} FROM s{i})")
        out.append(
            f"s{i + 1} AS (SELECT * EXCLUDE (t), list_reduce(list_prepend(t, h_{kind}), "
            f"lambda acc, x: replace(acc, x, {repl})) AS t FROM f{i})"
        )
    return ",\n".join(out)


LAST = f"s{len(P.KIND_ORDER)}"


def hits_cte(key: str = "doc_id") -> str:
    """``hits(doc_id, pass, seq, kind, original)`` from the pass."""
    parts = [
        f"SELECT {key}, {10 + i} AS pass, unnest(h_{kind}) AS original, generate_subscripts(h_{kind}, 1) - 1 AS seq, "
        f"'{kind}' AS kind FROM {LAST}"
        for i, kind in enumerate(P.KIND_ORDER)
    ]
    return "hits AS (" + " UNION ALL ".join(parts) + ")"


def counts_sql(by: str = "lang") -> str:
    return f"WITH {pass_ctes('documents', f'doc_id, {by}')}, {hits_cte_with(by)} SELECT {by}, kind, count(*) AS n FROM hits GROUP BY ALL"


def hits_cte_with(by: str) -> str:
    parts = [f"SELECT doc_id, {by}, unnest(h_{kind}) AS original, '{kind}' AS kind FROM {LAST}" for kind in P.KIND_ORDER]
    return "hits AS (" + " UNION ALL ".join(parts) + ")"


CORPUS = (
    "corpus AS (SELECT *, source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || ext AS rel_path FROM "
    f"(SELECT *, ([{', '.join(lit(e) for e in EXTENSIONS)}])[doc_id % {len(EXTENSIONS)} + 1] AS ext FROM documents))"
)

# text -------------------------------------------------------------------------
BLANKS = r"\t-\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def rx(pattern: str) -> str:
    """A pattern of the library as a SQL string."""
    return lit(pattern.replace(P.WS, BLANKS))


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"


SENT_CUT = "([。！？!?；;…\\n\\r])"


def sentences(t: str) -> str:
    """List of sentences: mark every end, split on the mark, squeeze, drop blanks."""
    marked = f"regexp_replace({t}, '{SENT_CUT}', '\\1' || chr(1), 'g')"
    squeezed = "trim(regexp_replace(s, '[[:space:]]+', ' ', 'g'))"
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {squeezed}), lambda s: s <> '')"
    )


LATIN = "[A-Za-z0-9][A-Za-z0-9''+\\-./]*"
CJK_RUN = "[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]+"


def words(t: str) -> str:
    return f"list_transform(regexp_extract_all({t}, '{LATIN}'), lambda w: lower(w))"


def cjk_grams(t: str, n: int = 2) -> str:
    return (
        f"flatten(list_transform(regexp_extract_all({t}, '{CJK_RUN}'), lambda r: list_transform("
        f"range(1, length(r) - {n - 2}), lambda i: substr(r, i, {n}))))"
    )


def sim_tokens(t: str) -> str:
    return f"list_distinct(list_concat({cjk_grams(t)}, {words(t)}))"


def lines(t: str) -> str:
    cut = r"\r\n|[\n\r]"
    return f"string_split(regexp_replace(regexp_replace({t}, '(\\r\\n|[\\n\\r])$', ''), '{cut}', chr(1), 'g'), chr(1))"


REPLIES = (
    "pairs AS (SELECT a.conv_id || '-' || a.turn AS pair_id, a.text AS left_text, b.text AS right_text "
    "FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1)"
)
