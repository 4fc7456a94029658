"""Text Column functions: typos, number formats, JSON salvage, keyword classification.

All but one are built-in Spark expressions (regex, higher-order array functions, string functions); the
lookup of some 160 keywords in long texts is one pass over Arrow batches (``keywords``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import keywords as KW

# ------------------------------------------------------------------- keyboard

# fixed values: the three letter rows of a QWERTY keyboard
KEY_ROWS = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]


def keyboard_neighbours() -> dict[str, list[str]]:
    """Neighbours by key geometry: same row left/right; the row above is shifted left
    (columns c, c+1), the row below shifted right (columns c-1, c)."""
    out: dict[str, list[str]] = {}
    for r, row in enumerate(KEY_ROWS):
        for c, ch in enumerate(row):
            nb = []
            for rr, cc in ((r, c - 1), (r, c + 1), (r - 1, c), (r - 1, c + 1), (r + 1, c - 1), (r + 1, c)):
                if 0 <= rr < len(KEY_ROWS) and 0 <= cc < len(KEY_ROWS[rr]):
                    nb.append(KEY_ROWS[rr][cc])
            out[ch] = nb
    return out


def _neighbour_map() -> Column:
    nb = keyboard_neighbours()
    args = []
    for k in sorted(nb):
        args += [F.lit(k), F.array(*[F.lit(v) for v in nb[k]])]
    return F.create_map(*args)


# fixed values: order of typo kinds (adjacent key, transposition, repetition, deletion, lower case)
TYPO_KINDS = ["adjacent", "transpose", "repeat", "delete", "case"]


def typo_kind_count() -> int:
    return len(TYPO_KINDS)


def typo_adjacent(x: Column, u_pos: Column, u_adj: Column) -> Column:
    """Replace one ASCII letter by a keyboard neighbour (case kept); unchanged without letters."""
    cand = F.filter(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))),
                    lambda i: F.lower(F.substr(x, i, F.lit(1))).rlike("^[a-z]$"))
    n = F.size(cand)
    idx = F.element_at(cand, (F.floor(u_pos * n) + F.lit(1)).cast("int"))
    ch = F.substr(x, idx, F.lit(1))
    nbs = F.element_at(_neighbour_map(), F.lower(ch))
    rep = F.element_at(nbs, (F.floor(u_adj * F.size(nbs)) + F.lit(1)).cast("int"))
    rep = F.when(ch != F.lower(ch), F.upper(rep)).otherwise(rep)
    return F.when(n == 0, x).otherwise(F.overlay(x, rep, idx, F.lit(1)))


def typo_transpose(x: Column, u: Column) -> Column:
    i = F.floor(u * (F.length(x) - F.lit(1))).cast("int")
    swapped = F.concat(F.substr(x, F.lit(1), i), F.substr(x, i + 2, F.lit(1)), F.substr(x, i + 1, F.lit(1)),
                       F.substr(x, i + 3))
    return F.when(F.length(x) < 2, x).otherwise(swapped)


def typo_repeat(x: Column, u: Column) -> Column:
    i = F.floor(u * F.length(x)).cast("int")
    out = F.concat(F.substr(x, F.lit(1), i + 1), F.substr(x, i + 1, F.lit(1)), F.substr(x, i + 2))
    return F.when(F.length(x) < 1, x).otherwise(out)


def typo_delete(x: Column, u: Column) -> Column:
    i = F.floor(u * F.length(x)).cast("int")
    out = F.concat(F.substr(x, F.lit(1), i), F.substr(x, i + 2))
    return F.when(F.length(x) <= 1, x).otherwise(out)


def typo_case(x: Column) -> Column:
    return F.lower(x)


def apply_typo(x: Column, kind: Column, u_pos: Column, u_adj: Column) -> Column:
    return (F.when(kind == 0, typo_adjacent(x, u_pos, u_adj))
            .when(kind == 1, typo_transpose(x, u_pos))
            .when(kind == 2, typo_repeat(x, u_pos))
            .when(kind == 3, typo_delete(x, u_pos))
            .otherwise(typo_case(x)))


# ------------------------------------------------------------------- numbers


def format_western(x: Column) -> Column:
    """Comma grouping in threes, 2 decimals (half-even on the exact binary value)."""
    return F.format_number(x.cast("double"), 2)


def format_indian(x: Column) -> Column:
    """Lakh/crore grouping: last three digits, then groups of two; 2 decimals, sign kept."""
    plain = F.regexp_replace(F.format_number(F.abs(x.cast("double")), 2), ",", "")
    int_part = F.substring_index(plain, ".", 1)
    dec_part = F.substring_index(plain, ".", -1)
    n = F.length(int_part)
    head = F.substr(int_part, F.lit(1), n - F.lit(3))
    tail = F.substr(int_part, n - F.lit(2), F.lit(3))
    grouped_head = F.regexp_replace(head, r"(\d)(?=(\d\d)+$)", "$1,")
    body = F.when(n <= 3, int_part).otherwise(F.concat(grouped_head, F.lit(","), tail))
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(x.isNull(), F.lit(None)).otherwise(F.concat(sign, body, F.lit("."), dec_part))


def format_money(x: Column, style: Column | str) -> Column:
    st = F.lit(style) if isinstance(style, str) else style
    return F.when(st == F.lit("indian"), format_indian(x)).otherwise(format_western(x))


# ------------------------------------------------------------------- JSON


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def json_candidates(x: Column) -> list[Column]:
    """Candidate texts in order: whole text, ```json fence, any fence, outermost {..}, outermost [..]."""
    s = _strip(x)
    return [
        s,
        F.regexp_extract(s, r"```json\s*([\s\S]*?)\s*```", 1),
        F.regexp_extract(s, r"```\s*([\s\S]*?)\s*```", 1),
        F.regexp_extract(s, r"\{[\s\S]*\}", 0),
        F.regexp_extract(s, r"\[[\s\S]*\]", 0),
    ]


def json_salvage(x: Column) -> Column:
    """struct(strategy int 1..5 or null, text of the candidate that parsed, value as VARIANT)."""
    cands = json_candidates(x)
    strategy = F.lit(None).cast("int")
    text = F.lit(None).cast("string")
    for i in reversed(range(len(cands))):
        ok = F.try_parse_json(cands[i]).isNotNull() & (cands[i] != F.lit(""))
        strategy = F.when(ok, F.lit(i + 1)).otherwise(strategy)
        text = F.when(ok, cands[i]).otherwise(text)
    return F.struct(strategy.alias("strategy"), text.alias("json_text"), F.try_parse_json(text).alias("value"))


# ------------------------------------------------------------ keyword lookups

# fixed values: domain keywords, in the order domains are tried (first wins ties)
DOMAIN_KEYWORDS: dict[str, list[str]] = {
    "healthcare": ["patient", "hospital", "doctor", "medical", "clinical", "health", "diagnosis", "treatment",
                   "pharma", "nurse", "physician", "illness", "therapy", "ward", "prescription"],
    "banking": ["bank", "loan", "credit", "debit", "account", "transaction", "payment", "savings", "deposit",
                "mortgage", "lending", "banking", "investment", "portfolio", "finance"],
    "retail": ["store", "shop", "purchase", "order", "customer", "product", "inventory", "sku", "sale",
               "discount", "ecommerce", "cart", "checkout", "merchant", "retail"],
    "hr": ["employee", "staff", "payroll", "salary", "department", "hire", "onboarding", "hr", "human resources",
           "workforce", "attendance", "leave", "appraisal", "headcount", "talent"],
    "agriculture": ["crop", "farm", "farmer", "harvest", "soil", "irrigation", "yield", "agriculture", "rainfall",
                    "fertilizer", "cattle", "livestock", "paddy", "wheat", "sowing"],
    "iot": ["sensor", "device", "iot", "telemetry", "reading", "temperature", "humidity", "signal", "edge",
            "firmware", "mqtt", "gateway", "actuator", "stream", "timestamp"],
    "insurance": ["policy", "premium", "claim", "insured", "beneficiary", "coverage", "risk", "underwriting",
                  "insurance", "liability", "renewal", "deductible", "agent", "actuarial", "reinsurance"],
    "logistics": ["shipment", "delivery", "freight", "warehouse", "tracking", "courier", "cargo", "fleet", "route",
                  "logistics", "dispatch", "inventory", "supply chain", "fulfillment", "transport"],
    "education": ["student", "school", "grade", "teacher", "course", "enrollment", "exam", "marks", "curriculum",
                  "university", "college", "lecture", "assignment", "academic", "campus"],
    "real_estate": ["property", "rent", "lease", "apartment", "house", "listing", "mortgage", "realty",
                    "real estate", "tenant", "landlord", "broker", "square feet", "valuation", "plot"],
}

# fixed values: state/city keywords (substring match, tried first, in this order)
STATE_KEYWORDS: list[tuple[str, str, str]] = [
    ("maharashtra", "Maharashtra", "India"), ("mumbai", "Maharashtra", "India"),
    ("karnataka", "Karnataka", "India"), ("bangalore", "Karnataka", "India"), ("bengaluru", "Karnataka", "India"),
    ("delhi", "Delhi", "India"), ("tamil nadu", "Tamil Nadu", "India"), ("gujarat", "Gujarat", "India"),
    ("punjab", "Punjab", "India"), ("rajasthan", "Rajasthan", "India"),
    ("california", "California", "United States"), ("new york", "New York", "United States"),
    ("texas", "Texas", "United States"),
]

# fixed values: country keywords (whole-word match, in this order)
COUNTRY_KEYWORDS: list[tuple[str, str]] = [
    ("india", "India"), ("indian", "India"), ("usa", "United States"), ("us", "United States"),
    ("american", "United States"), ("america", "United States"), ("uk", "United Kingdom"),
    ("british", "United Kingdom"), ("england", "United Kingdom"), ("germany", "Germany"), ("german", "Germany"),
    ("france", "France"), ("french", "France"), ("australia", "Australia"), ("australian", "Australia"),
    ("canada", "Canada"), ("canadian", "Canada"), ("singapore", "Singapore"), ("brazil", "Brazil"),
    ("brazilian", "Brazil"), ("china", "China"), ("chinese", "China"), ("japan", "Japan"), ("japanese", "Japan"),
    ("nigeria", "Nigeria"), ("nigerian", "Nigeria"), ("kenya", "Kenya"),
]

# fixed values: row-count patterns, tried in order (case-insensitive)
ROW_COUNT_PATTERNS = [
    r"\b(\d[\d,]*)\s*(?:rows?|records?|entries|samples?|data points?)\b",
    r"\bgenerate\s+(\d[\d,]*)\b",
    r"\bcreate\s+(\d[\d,]*)\b",
    r"\b(\d[\d,]*)\s*(?:rows?|records?)\b",
]
ROW_COUNT_DEFAULT = 1000

WORD_EDGE_L = r"(^|[^\p{L}\p{N}_])"
WORD_EDGE_R = r"([^\p{L}\p{N}_]|$)"


def keyword_hits(low: Column, groups: list[list[str]]) -> Column:
    """array<int>: for each group, how many of its keywords the text holds (substrings, bytewise; null: null).

    One pass over the text for all keywords (``keywords.count_hits``), where a test a keyword reads it once for each.
    """
    return F.arrow_udf(KW.counter(groups), "array<int>")(low)


def _domain_of(hits: Column) -> Column:
    names = list(DOMAIN_KEYWORDS)
    counts = F.slice(hits, 1, len(names))
    best = F.array_max(counts)
    first = F.array_position(counts, best).cast("int")
    return F.when(best > 0, F.element_at(F.array(*[F.lit(d) for d in names]), first)).otherwise(F.lit("general"))


def classify_domain(text: Column) -> Column:
    """Domain with the most keyword hits (substring), earlier domain wins ties, none -> 'general'."""
    return _domain_of(keyword_hits(F.lower(text), list(DOMAIN_KEYWORDS.values())))


def _row_count_of(found: list[Column]) -> Column:
    out = F.lit(ROW_COUNT_DEFAULT).cast("long")
    for raw in reversed(found):
        val = F.regexp_replace(raw, ",", "").try_cast("long")
        out = F.when(val.isNotNull() & (val >= 1), val).otherwise(out)
    return out


def _row_count_matches(text: Column) -> list[Column]:
    """First match of each pattern; null where the text has no digit, without which none matches."""
    digits = text.rlike("[0-9]")
    return [F.when(digits, F.regexp_extract(text, "(?i)" + pat, 1)) for pat in ROW_COUNT_PATTERNS]


def extract_row_count(text: Column) -> Column:
    """First pattern whose first match is a number of 1 or more; else 1000. Large requests come back as asked."""
    return _row_count_of(_row_count_matches(text))


def with_row_count(df: DataFrame, text_col: str, out: str = "row_count") -> DataFrame:
    """``extract_row_count`` staged as projections: each pattern is searched once per row."""
    tmp = {f"_rc{i}": m for i, m in enumerate(_row_count_matches(F.col(text_col)))}
    return df.withColumns(tmp).withColumn(out, _row_count_of([F.col(c) for c in tmp])).drop(*tmp)


def country_of(low: Column) -> Column:
    """First country keyword in list order that occurs as a whole word in the lower-cased text.

    One regex pass collects every whole-word keyword occurrence (look-arounds, so adjacent
    keywords are all found); the keyword with the smallest list position wins. The first two
    letters are tested before the look-behind, which costs more.
    """
    kws = [k for k, _ in COUNTRY_KEYWORDS]
    alt = "|".join(sorted(kws, key=len, reverse=True))
    first, second = ("".join(sorted({k[i] for k in kws})) for i in (0, 1))
    found = F.regexp_extract_all(low, F.lit(rf"(?=[{first}][{second}])(?<![\p{{L}}\p{{N}}_])({alt})(?![\p{{L}}\p{{N}}_])"), F.lit(1))
    pos = F.array_min(F.transform(found, lambda m: F.array_position(F.array(*[F.lit(k) for k in kws]), m)))
    names = F.array(*[F.lit(c) for _, c in COUNTRY_KEYWORDS])
    return F.when(pos > 0, F.element_at(names, pos.cast("int")))


def _region_of(country: Column, state: Column) -> Column:
    """struct(country, state) of the country named and the number of the state keyword (0: none)."""
    named = [F.element_at(F.array(*[F.lit(k[i]) for k in STATE_KEYWORDS]), state) for i in (1, 2)]
    return F.struct(F.coalesce(F.when(state > 0, named[1]), country).alias("country"), F.when(state > 0, named[0]).alias("state"))


def _state_number(hits: Column, first: int) -> Column:
    return F.array_position(F.slice(hits, first, len(STATE_KEYWORDS)), 1).cast("int")


def extract_region(text: Column) -> Column:
    """struct(country, state): first state keyword (substring), else first whole-word country keyword."""
    low = F.lower(text)
    hits = keyword_hits(low, [[k] for k, _, _ in STATE_KEYWORDS])
    return _region_of(country_of(low), _state_number(hits, 1))


def with_domain(df: DataFrame, text_col: str, out: str = "domain") -> DataFrame:
    """``classify_domain`` staged as projections, so the hits are counted once per row."""
    staged = df.withColumn("_kw", keyword_hits(F.lower(F.col(text_col)), list(DOMAIN_KEYWORDS.values())))
    return staged.withColumn(out, _domain_of(F.col("_kw"))).drop("_kw")


def with_domain_and_region(df: DataFrame, text_col: str, domain: str = "domain", region: str = "region") -> DataFrame:
    """``classify_domain`` and ``extract_region`` from one lower-cased text and one pass for all their keywords."""
    staged = df.withColumn("_low", F.lower(F.col(text_col)))
    staged = staged.withColumns({"_kw": keyword_hits(F.col("_low"), [*DOMAIN_KEYWORDS.values(), *([k] for k, _, _ in STATE_KEYWORDS)]),
                                 "_named": country_of(F.col("_low"))})
    staged = staged.withColumns({domain: _domain_of(F.col("_kw")), "_state": _state_number(F.col("_kw"), len(DOMAIN_KEYWORDS) + 1)})
    return staged.withColumn(region, _region_of(F.col("_named"), F.col("_state"))).drop("_low", "_kw", "_named", "_state")


def text_md5(text: Column) -> Column:
    return F.md5(text)
