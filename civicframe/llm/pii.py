"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

What is found is permuted by a keyed Feistel network within its format: digits stay digits, capitals capitals, hex hex, and punctuation
stays. Validated values stay valid: card and account numbers keep right check digits, an address stays a dotted quad, a date stays a day of the
same 400 years. A permutation maps equal values to equal pseudonyms, so documents stay linked, and no two values to one. Addresses of mail
are equal in whatever case they are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bind as _with

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Bounded by the standards' lengths, 64 (here 256) of a local part, 63 of a label and 127 labels, and possessive where that changes nothing: a
#: run of any length is passed over in steps of a bounded number, and the matcher never goes deep.
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,255}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}+){0,125}\.[A-Za-z]{2,63}"
ADDRESS6 = r"(?<![\w:])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){2,6}(?::[0-9a-fA-F]{1,4}){1,5}|[0-9a-fA-F]{1,4}:(?::[0-9a-fA-F]{1,4}){2,6})(?![\w:])"
#: Account numbers, with and without a last group that is short.
ACCOUNTS = (r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}\b", r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7} ?[0-9A-Z]{1,3}\b")
ADDRESS = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\d)"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
#: A number with its country code leaves an address, a date or a card behind it alone; <cards> stands for the cards of the text.
PHONE = rf"(?<![\d+])\+?\d{{0,3}}[ .-]?\(\d{{2,4}}\)[ .-]?\d{{3,4}}[ .-]?\d{{4}}(?!\d)|(?<!\d)\+\d{{1,3}}(?:(?![ .-]?(?:{ADDRESS}|{DATE}|<cards>))[ .-]?\d{{2,4}}){{2,4}}(?!\d)|(?<![\d-])\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}(?![\d-])"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
SECRET = r"(?:(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?\s*+[:=]\s*+[\"']?[A-Za-z0-9_/+=-]{8,}+[\"']?)|\bAKIA[0-9A-Z]{16}\b|\b(?:[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{32})\b"
#: Digits of a possible card, and the groups in which cards are written; from any group on, so that a number before it hides none.
RUN = r"\d(?:[ -]?\d){12}"
GROUPS = tuple(
    rf"(?<!\d)(?=(<first>{more})(?!\d{after}))"
    for more, after in (
        (r"\d{12,18}", ""),
        (r"\d{3}(?:[ -]\d{4}){3}", ""),
        (r"\d{3}(?:[ -]\d{4}){3}[ -]\d{1,3}", r"|[./]\d"),
        (r"\d{3}[ -](?:\d{6}[ -]\d{4,5}|\d{5}[ -]\d{6}|\d{4}[ -]\d{5}|\d{3}[ -]\d{3}[ -]\d{3})", r"|[./]\d"),
        (r"(?:\d{5}[ -]\d{13}|\d{7}[ -]\d{8})", ""),
    )
)
#: A whole run of digits, however grouped.
WHOLE = r"(?<!\d)(?<!\d[./ -])\d(?:[ -]?\d){12,18}(?![ -]?\d)(?![./]\d)"
#: Numbers with a wrong check digit that are counted but stay; they never reach into another value.
ALIKE = r"(?<!\d)(?:\d{13,19}(?!\d)|\d{4}(?:[ -]\d{4}){3}(?![ -]?\d|[./]\d|[\w.%+-]*@))"
NEVER = "(?!)"
#: In this order, at each place of a text. The cards, and the account numbers among them, are those with right check digits.
KINDS = {"secret": SECRET, "email": EMAIL, "address6": ADDRESS6, "address": ADDRESS, "date": DATE, "card": CARD, "phone": PHONE.replace("<cards>", NEVER), "social": SOCIAL}
FOUND = f"{SECRET}|{EMAIL}|{ADDRESS6}|{ADDRESS}|{DATE}|<all cards>|{PHONE}|{SOCIAL}"
#: Every value of KINDS has one of these, so texts without them are passed on as they are.
MAYBE = r"[0-9@:=]|AKIA"
ROUNDS = 8
#: Characters that are turned as one.
TURNED = 64
#: The days of 400 Gregorian years, 146,097 = 189 x 773, from this day on.
FIRST_DAY, HIGH, LOW = "1800-01-01", 189, 773
DATE_FORMS = {"-": "yyyy-MM-dd", "/": "dd/MM/yyyy", ".": "dd.MM.yyyy"}
#: For days that the form with the day first can't mean.
MONTH_FIRST = "MM/dd/yyyy"
#: Turns until a day with a number over 12 comes out: each misses with a probability of 0.4.
WALK = 64
HEX = "0123456789abcdef"
#: The column that holds the key.
SEALED = "pii_key"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(key: str, *parts: str) -> str:
    """A keyed pseudo-random number below 2**60."""
    return f"cast(conv(substr(sha2(concat_ws('|', {key}, {', '.join(parts)}), 256), 1, 15), 16, 10) as bigint)"


def _turned(key: str, x: str, hexadecimal: bool = False) -> str:
    """A string permuted within the classes of its characters: each half is shifted by a keyed digest of the other. Hexadecimal: small hex digits are one class.

    Longer strings are turned in blocks of ``TURNED`` characters, each keyed by its place and by the block before it as well, so that the work is in proportion to the length.
    """
    tweak = "if(at = 0, null, concat(cast(at as string), ':', element_at(blocks, at)))"
    return _with("blocks", f"regexp_extract_all({x}, '(?s).{{1,{TURNED}}}', 0)", f"array_join(transform(blocks, (block, at) -> {_turned_block(key, 'block', tweak, hexadecimal)}), '')")


def _turned_block(key: str, x: str, tweak: str, hexadecimal: bool) -> str:
    digest = f"sha2(concat_ws('|', {key}, cast(i as string), s.r, {tweak}), 512)"
    shift = "cast(conv(substr(d, 1 + 4 * ((j - 1) % 32), 4), 16, 10) as int)"
    char = "substr(s.l, j, 1)"
    moved = "case " + " ".join(f"when {char} between '{a}' and '{z}' then char({ord(a)} + (ascii({char}) - {ord(a)} + {shift}) % {ord(z) - ord(a) + 1})" for a, z in ("09", "az", "AZ")) + f" else {char} end"
    if hexadecimal:
        moved = f"case when {char} between '0' and '9' or {char} between 'a' and 'f' then substr('{HEX}', 1 + (instr('{HEX}', {char}) - 1 + {shift}) % 16, 1) else {char} end"
    left = f"array_join(flatten(transform(array({digest}), d -> transform(filter(sequence(1, greatest(length(s.l), 1)), j -> j <= length(s.l)), j -> {moved}))), '')"
    half = f"cast(length({x}) div 2 as int)"
    start = f"named_struct('l', substr({x}, 1, {half}), 'r', substr({x}, {half} + 1))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> named_struct('l', s.r, 'r', {left}), s -> concat(s.l, s.r))"


def _weighted(digits: str, doubled: int) -> str:
    """Sum of the digits, those of this parity of the place from the right doubled, as the check digit rule has it."""
    digit = f"cast(substr({digits}, length({digits}) - q, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, q) -> t + case when q % 2 <> {doubled} then {digit} when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end)"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _put(x: str, made: str, kept: str) -> str:
    """The characters of ``made`` at the places of those of x that are in the class ``kept``."""
    place = f"length(regexp_replace(substr({x}, 1, p), '[^{kept}]', ''))"
    return f"array_join(transform(sequence(1, length({x})), p -> if(substr({x}, p, 1) rlike '[{kept}]', substr({made}, {place}, 1), substr({x}, p, 1))), '')"


def _cased(x: str, made: str) -> str:
    """``made`` with capitals where x has them."""
    return f"array_join(transform(sequence(1, length({made})), p -> if(substr({x}, p, 1) rlike '[A-Z]', upper(substr({made}, p, 1)), substr({made}, p, 1))), '')"


def _card(key: str, x: str) -> str:
    body = _with("b", _turned(key, "substr(d, 1, length(d) - 1)"), f"concat(b, cast((10 - {_weighted('b', 0)} % 10) % 10 as string))")
    return _with("d", _digits(x), f"if({_weighted('d', 1)} % 10 = 0, {_with('e', body, _put(x, 'e', '0-9'))}, {x})")


def _mod97(body: str, head: str) -> str:
    """The remainder of an account number's letters and digits, its first four characters behind the others."""
    code = "ascii(ch)"
    step = f"case when {code} > 64 then (t * 100 + {code} - 55) % 97 else (t * 10 + {code} - 48) % 97 end"
    return f"aggregate(filter(split(concat({body}, {head}), ''), z -> z <> ''), 0, (t, ch) -> {step})"


def _account(key: str, x: str) -> str:
    body = _with("b", _turned(key, "substr(d, 5)"), f"concat(substr(d, 1, 2), lpad(cast(98 - {_mod97('b', 'concat(substr(d, 1, 2), chr(48), chr(48))')} as string), 2, '0'), b)")
    return _with("d", f"replace({x}, ' ', '')", _with("e", body, _put(x, "e", "0-9A-Z")))


def _right(values: str) -> str:
    """Those of an array of numbers whose check digit is right, each once."""
    return f"filter(array_distinct({values}), c -> {_with('d', _digits('c'), f'{_weighted("d", 1)} % 10 = 0')})"


def _right_accounts(text: str) -> str:
    found = ", ".join(f"regexp_extract_all({text}, {_quoted(a)}, 0)" for a in ACCOUNTS)
    plain = "replace(c, ' ', '')"
    return f"filter(array_distinct(concat({found})), c -> {_mod97(f'substr({plain}, 5)', f'substr({plain}, 1, 4)')} = 1)"


def _any(values: str) -> str:
    """A regular expression for the numbers of an array, the longest first."""
    return f"if(size({values}) = 0, {_quoted(NEVER)}, concat({_quoted(r'(?<!\d)(?:')}, array_join(array_sort({values}, (p, q) -> length(q) - length(p)), '|'), {_quoted(r')(?!\d)')}))"


def _pattern(text: str) -> str:
    """The regular expression for the values of a text.

    A check digit is beyond a regular expression, so the cards are looked up first: in the groups in which cards are written, at any place of
    a run of digits; then, in what is neither these nor another kind, whole runs and the longest starts of runs, however grouped. The
    digits around a card are left to the other kinds.
    """
    plain = f"{FOUND}|{ALIKE}".replace("<all cards>", NEVER).replace("<cards>", NEVER)

    def found(cards: str, all_cards: str, more: str = "") -> str:
        sql = _quoted(FOUND + more)
        return f"replace(replace({sql}, '<all cards>', {all_cards}), '<cards>', {cards})"

    def groups(x: str, first: str) -> str:
        return "flatten(array(" + ", ".join(f"regexp_extract_all({x}, {_quoted(g.replace('<first>', first))}, 1)" for g in GROUPS) + "))"

    grouped = _right(groups(text, "[2-6]"))
    whole = f"filter(regexp_extract_all({text}, {_quoted(WHOLE)}, 0), c -> not exists(r, y -> instr(c, y) > 0))"
    rest = _with("m", f"regexp_replace({text}, {found('a', 'a')}, '|')", f"concat(regexp_extract_all(m, {_quoted(CARD)}, 0), {groups('m', '[0-9]')})")
    others = _with("o", _right(f"concat({whole}, {rest})"), _any("o"))
    account = _with("k", _right_accounts(text), f"if(size(k) = 0, '', concat({_any('k')}, '|'))")
    cards = _with("r", grouped, _with("a", _any("r"), _with("b", others, _with("n", account, found("a", "concat(n, a, '|', b)", f"|{ALIKE}")))))
    return f"case when {text} rlike {_quoted(f'{RUN}|{ACCOUNTS[0]}|{ACCOUNTS[1]}')} then {cards} else {_quoted(plain)} end"


def _address(key: str, x: str) -> str:
    octet = [f"cast(split({x}, '[.]')[{i}] as int)" for i in range(4)]
    start = f"named_struct('l', {octet[0]} * 256 + {octet[1]}, 'r', {octet[2]} * 256 + {octet[3]})"
    turn = f"named_struct('l', s.r, 'r', cast(s.l ^ ({_number(key, 'cast(i as string)', 'cast(s.r as string)')} % 65536) as int))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> {turn}, s -> concat_ws('.', s.l div 256, s.l % 256, s.r div 256, s.r % 256))"


def _date(key: str, x: str) -> str:
    days = f"datediff(v, date'{FIRST_DAY}')"
    start = f"named_struct('l', cast({days} div {LOW} as bigint), 'r', cast({days} % {LOW} as bigint))"
    odd = f"named_struct('l', (s.l + {_number(key, 'cast(i as string)', 'cast(s.r as string)')}) % {HIGH}, 'r', s.r)"
    even = f"named_struct('l', s.l, 'r', (s.r + {_number(key, 'cast(i as string)', 'cast(s.l as string)')}) % {LOW})"
    day = f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> if(i % 2 = 1, {odd}, {even}), s -> date_add(date'{FIRST_DAY}', cast(s.l * {LOW} + s.r as int)))"
    inside = f"{days} >= 0 and {days} < {HIGH * LOW}"
    first = f"aggregate(sequence(1, {WALK}), named_struct('d', v, 'k', 0), (w, j) -> if(w.k > 0 and dayofmonth(w.d) > 12, w, named_struct('d', {_with('v', 'w.d', day)}, 'k', 1)), w -> date_format(w.d, '{MONTH_FIRST}'))"
    other = _with("v", f"to_date(try_to_timestamp({x}, '{MONTH_FIRST}'))", f"case when v is not null and {inside} then {first} else {x} end")
    out = x
    for mark, form in DATE_FORMS.items():
        value = f"to_date(try_to_timestamp({x}, '{form}'))"
        made = f"case when v is null then {other if mark == '/' else x} when {inside} then date_format({day}, {_quoted(form)}) else {x} end"
        out = f"case when instr({x}, '{mark}') > 0 then {_with('v', value, made)} else {out} end"
    return out


def _pseudonym(key: str, x: str = "x") -> str:
    """SQL for the pseudonym of a value found."""

    def parted(head: str) -> str:
        """The head stays, the rest is turned."""
        return _with("h", f"regexp_extract({x}, {_quoted(head)}, 0)", f"concat(h, {_with('g', f'substr({x}, length(h) + 1)', _turned(key, 'g'))})")

    head = f"substring_index({x}, {_quoted('.')}, size(split({x}, {_quoted('[.]')})) - 1)"
    mail = _with("g", f"lower({head})", f"concat({_with('e', _turned(key, 'g'), _cased(x, 'e'))}, '.', substring_index({x}, '.', -1))")
    address6 = _with("g", f"lower({x})", _with("e", _turned(key, "g", True), _cased(x, "e")))
    full = {k: _quoted(f"^(?:{v})$") for k, v in KINDS.items()}
    opening = r"^(?:AKIA|(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?\s*+[:=]\s*+[\"']?)?"
    hexed = "length(g) >= 16 and g rlike '^[0-9a-f]*[a-f][0-9a-f]*[\"\\']?$'"
    secret = _with("h", f"regexp_extract({x}, {_quoted(opening)}, 0)", f"concat(h, {_with('g', f'substr({x}, length(h) + 1)', f'if({hexed}, {_turned(key, "g", True)}, {_turned(key, "g")})')})")
    arms = {
        f"{x} rlike {full['secret']}": secret,
        f"instr({x}, '@') > 0": mail,
        f"{x} rlike {full['address6']}": address6,
        f"{x} rlike {full['address']}": _address(key, x),
        f"{x} rlike {full['date']}": _date(key, x),
        f"{x} rlike '^[A-Z]'": _account(key, x),
        f"{x} rlike {full['card']}": _card(key, x),
    }
    return "case " + " ".join(f"when {k} then {v}" for k, v in arms.items()) + f" else {parted(r'^(?:\+\d{1,3}(?=[ .(-]))?')} end"


def pseudonymize(docs: DataFrame, key: str, column: str = "text", count: str | None = "n_pii") -> DataFrame:
    """``docs`` with the personal data of ``column`` replaced, and the number of values replaced in ``count`` (None: no such column).

    A null text stays null and has none; an empty one stays empty. All other columns and repeated rows pass through; a column
    named as ``count`` is replaced. The same key gives the same pseudonyms in every run; it comes from a table of one row, so no plan or event log
    shows it. Card and account numbers with wrong check digits and impossible dates aren't validated: they stay, and aren't counted. Social and phone
    numbers have no check; their digits are turned as they are. A date is read with the day first, and with the month first where it can't be. Nothing is shuffled.
    """
    sealed, made = SEALED, "pii_made"
    while {sealed, made} & {*docs.columns}:
        sealed, made = f"_{sealed}", f"_{made}"
    text = f"`{column}`"
    keys = docs.sparkSession.createDataFrame([(key,)], "k string")
    new = f"transform(o, x -> {_pseudonym(f'`{sealed}`')})"
    parts = f"array_join(zip_with(split({text}, f, -1), n, (a, b) -> concat(a, coalesce(b, ''))), '')"
    both = f"named_struct('text', {parts}, 'n', cast(size(filter(zip_with(o, n, (a, b) -> a <> b), z -> z)) as bigint))"
    body = _with("f", _pattern(text), _with("o", f"regexp_extract_all({text}, f, 0)", _with("n", new, both)))
    found = f"case when {text} rlike {_quoted(MAYBE)} then {body} else named_struct('text', {text}, 'n', 0L) end"
    out = docs.withColumn(sealed, keys.scalar()).withColumn(made, F.expr(found))
    return out.withColumns({column: F.col(f"{made}.text")} | ({count: F.col(f"{made}.n")} if count else {})).drop(sealed, made)
