"""Template residue, filler, error pages and script notices.

Two kinds of evidence are combined for each page:
* placeholder and filler detectors over title and body, line by line; a placeholder that the prose speaks
  about ("a pattern like ...") does not count;
* duplication of low-information responses. A response is cut into clauses, codes, numbers, paths and letter case set aside. Clauses that
  stand in low-information responses of many addresses and of several hosts are what servers say, not what a page says:
  they are counted over the whole corpus. The share of a page's own text that such clauses make up is compared together with
  its mismatches: the terms of the address slug against the body, the slug against the title, and an error status.

A site's name, the title repeated and a first line without an end mark above others say nothing either way. Words typical of notices
only let a clause count as familiar that was seen too seldom, and only half.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.rows import map_rows
from pagestrata.runtime import one_delivery, written

# Syntaxes of template languages and mail-merge fields.
PLACEHOLDER = re.compile(
    r"\{\{\{?\s*[\w.$\-| ]+\s*\}?\}\}"
    r"|\{%.{1,80}?%\}"
    r"|\$\{\s*[\w.]+\s*\}"
    r"|\{\$[\w.\->]+\}"
    r"|<%=?.{1,80}?%>"
    r"|<\?(?:php|=).{1,80}?\?>"
    r"|%%\w+%%"
    r"|@@\w+@@"
    r"|\*\|\w+\|\*"
    r"|\[\[[\w.]+\]\]"
    r"|#[A-Z][A-Z_]{2,}#"
    r"|(?<!\w)__[A-Z][A-Z_]*[A-Z]__(?!\w)"
    r"|\[(?:insert|your|enter|add|placeholder)\b[^\]]{0,60}\]"
    r"|\[[^\]]{0,40}\b(?:goes here|here)\]",
    re.I,
)
_UPPER_ONLY = re.compile(r"^(?:#[^#]+#|__\w+__)$")
MENTION_BEFORE = re.compile(r"(?:such as|like|called|named|e\.g\.|for example|for instance|write|written|type|spelled|says?|shows?|reads?|look for|field|pattern|placeholder|variable|syntax|code)[\s:\"'“‘(]*$", re.I)
MENTION_AFTER = re.compile(r"^[\s\"'”’),]*(?:stands? for|means?|marks?|denotes?|is (?:replaced|a placeholder|where)|are replaced)", re.I)

# Fixed value: the vocabulary of printers' dummy Latin.
DUMMY_LATIN = frozenset(
    "ac accumsan ad adipiscing aenean aliqua aliquam aliquip amet anim ante aptent arcu at auctor augue aute bibendum blandit cillum class "
    "commodo condimentum congue consectetur consequat convallis cras culpa cupidatat curabitur cursus dapibus deserunt diam dictum "
    "dignissim do dolor dolore donec dui duis ea efficitur egestas eget eiusmod eleifend elementum elit enim erat eros esse est et etiam eu "
    "euismod ex excepteur exercitation facilisi facilisis fames faucibus felis fermentum feugiat finibus fringilla fugiat fusce gravida "
    "habitant hendrerit iaculis id imperdiet in incididunt integer interdum ipsum irure justo labore laboris laborum lacinia lacus laoreet "
    "lectus leo libero ligula lobortis lorem luctus maecenas magna malesuada massa mattis mauris maximus metus mi minim molestie mollis "
    "mollit morbi nam nec neque nibh nisi nisl non nostrud nulla nullam nunc occaecat odio officia orci ornare pariatur pellentesque "
    "pharetra phasellus placerat porta porttitor posuere potenti praesent pretium proident proin pulvinar purus quam quis quisque "
    "reprehenderit rhoncus risus rutrum sagittis sapien scelerisque sed sem semper senectus sint sit sodales sollicitudin sunt suscipit "
    "suspendisse tellus tempor tempus tincidunt tortor tristique turpis ullamco ullamcorper ultrices ultricies urna ut varius vehicula vel "
    "velit venenatis veniam vestibulum vitae vivamus viverra volutpat voluptate vulputate".split()
)
# Fixed value: words people type where text is still to come.
NONSENSE = frozenset("foo bar baz qux quux blah bla asdf asdfasdf qwerty qwertz zxcv hjkl lorem ipsum xxx xxxx test testtest dummy tbd tba".split())
FILLER = re.compile(
    r"^\W*(?:todo|to do|tbd|tba|fixme|xxx+|tk)\b\s*[:\-–]"
    r"|\bthis is an? (?:sample|example|dummy|test|default|placeholder) (?:text|heading|headline|title|paragraph|widget|page|post|block|description|section|content)"
    r"|\b(?:double[- ])?click (?:here |on it )?to (?:edit|change)\b"
    r"|\breplace (?:it|this|me|this text) with your own\b"
    r"|\b(?:dummy|sample|test|placeholder|filler|blind) (?:text|content|copy|description|title|headline|heading)\s+(?:goes|comes|stands|is)\s+here\b"
    r"|\byour (?:text|title|content|headline|copy|description|message)\s+(?:goes\s+|comes\s+)?here\b"
    r"|\b(?:text|content|title|description|headline) (?:goes|comes) here\b"
    r"|^\W*(?:type|put|add|enter|write|insert|place|paste) (?:in )?(?:your|the|a|an|some) (?:\w+ ){1,4}here\b",
    re.I,
)

# What servers, gates and script checks say, by kind.
NOTICES = {
    "missing": r"page you (?:asked|were looking|requested|are looking)|that (?:page|link) (?:is gone|seems|does not|doesn't)|(?:page|link|address|url|resource|file) (?:was |could |can|is )?(?:not (?:be )?found|gone|broken|missing)|moved or never was|nothing (?:lives|is|was found|here) at this|(?:est|is) (?:absente?|missing) (?:de|from) (?:notre|our)|no longer (?:exists|available|here)|does ?n[o']t exist|looked everywhere|n'existe (?:plus|pas)|ya no existe|\bno (?:se )?(?:existe|encuentra|encontr)|nicht (?:gefunden|mehr (?:verfügbar|da))|gibt es nicht|introuvable|http (?:error )?4\d\d|\b404\b|страниц\w+ не (?:найден|существ)|見つかりません",
    "server": r"server (?:ran into|is (?:busy|down)|error|hit|antwortet|überlastet)|internal (?:server )?error|unexpected (?:condition|error|problem)|upstream|gateway|origin (?:is|was)|unreachable|service (?:is )?(?:temporarily |currently )?unavailable|temporarily unavailable|service en panne|something (?:went wrong|broke)|retry in a|our team has been told|incident [0-9a-f]{4,}|hors service|no responde|fuera de servicio|antwortet (?:gerade )?nicht|ошибка сервера|сервер\w* не отвечает",
    "upkeep": r"(?:scheduled|planned) (?:upkeep|work|maintenance|downtime)|under (?:maintenance|construction)|down for|be(?: right)? back|back (?:at|soon)|expected return|wartung|wird gebaut|bald zurück|en (?:mantenimiento|construcción|maintenance|travaux)|volvemos|revenir plus tard|vuelva|de retour|техническ\w+ работ",
    "trace": r"(?:could not|cannot|can't|failed to|error|unable to) (?:connect|establish)\w*|query (?:timed out|failed)|too many connections|(?:fatal|parse|syntax) error|undefined (?:index|variable|offset|function|property)|\bin /\S+ (?:on line|line|:)|call to a member function|traceback|stack ?trace|uncaught|exception\b.*\b(?:in|at)\b|(?:notice|warning|deprecated): .* in /|segmentation fault|null ?pointer|data(?:base)? (?:link|connection|error)",
    "denied": r"access (?:denied|to this|is (?:denied|forbidden))|(?:not|aren't) (?:allowed|permitted|authori[sz]ed)|forbidden|blocked by|request (?:was|has been) blocked|permission|sign in (?:again )?to|log ?in (?:again|required|to continue)|session (?:has )?(?:expired|timed out|ended)|token (?:is|has) (?:no longer|expired|invalid|not)|keine (?:berechtigung|rechte)|zugriff verweigert|acceso denegado|no tiene (?:permiso|acceso)|accès (?:refusé|interdit)|ne pouvez pas|n'avez pas|доступ запрещ|нет доступа",
    "rate": r"too many requests|sent too many|rate limit|slow down|wait \d+ (?:seconds|minutes)|zu viele anfragen|demasiadas (?:peticiones|solicitudes)|trop de requêtes",
    "scripts": r"(?:enable|allow|turn on|activate|activez|active|aktivieren|activa|habilite|schalten sie|включите)\b.{0,30}(?:javascript|\bjs\b|scripts?\b|skripte|скрипт)|(?:javascript|\bjs|scripts?|scripting|skripte)\b.{0,30}(?:disabled|blocked|required|necess|nécess|needed|\boff\b|not available|unavailable|turned off|aktivier|erforderlich|ein, um)|(?:without|needs?|requires?|depends? on|necesita|falta|ohne|sans|sin|besoin de)\s+(?:javascript|js\b|scripts?\b|skripte)|without javascript|unless your browser (?:runs|allows|supports)|browser (?:runs|allows|supports) (?:no )?(?:java)?scripts?|switched off in your browser|включ\w+ javascript",
    "check": r"checking (?:your|if your) (?:browser|connection)|verif(?:y|ying) (?:that )?you(?:'re| are) (?:a )?human|test your connection|(?:just|one) (?:a )?moment,? (?:verify|please|while|we)|hold on while|you will be sent on|are you (?:a )?(?:human|robot)|captcha|ddos|browser check|needs javascript and cookies|überprüf\w+ (?:ihren|deinen) browser",
}
NOTICE = re.compile("|".join(f"(?P<{k}>{v})" for k, v in NOTICES.items()), re.I)
SPOKEN_OF = re.compile(r"\b(?:says?|said|such as|called|named|reads?|the words?|speaks? of|the message|messages? that|explains?|stands? for|errors like|pages? like|if (?:the|a|your) \w+(?: \w+)? (?:says|shows|reads))\b", re.I)
LOADING = re.compile(r"^\W*(?:loading|please wait|wird geladen|chargement|cargando|загрузка)\b", re.I)

# Responses of at most so many words teach which clauses are familiar; every page, of any length, is judged by them.
TEACHING_WORDS = 48
# A clause is familiar from this many addresses, or this share of the teaching responses if that is more, on LEAST_HOSTS hosts
# (or three times as many addresses on one).
LEAST_ADDRESSES = 3
FAMILIAR_SHARE = 1 / 3000
LEAST_HOSTS = 2
# Weights of the evidence beside the familiar share of the text (0..1), and the sum from which a page is excluded.
NOTICE_WEIGHT, SLUG_WEIGHT, TITLE_WEIGHT, STATUS_WEIGHT = 0.5, 0.1, 0.05, 0.1
EXCLUDED_FROM = 0.72
_WORD = re.compile(r"[^\W\d_]+")
_NOT_ALNUM = re.compile(r"[\W_]+")
_CODE = re.compile(r"\b[A-Z]{2}-\d+\b|\b(?=\w*\d)\w+\b")


_PLACEHOLDING = DUMMY_LATIN | NONSENSE
# Fixed value: words of either vocabulary that ordinary texts hold; a line of nothing else is no filler.
_ORDINARY = frozenset("a ac ad ante at culpa do duis ea est et eu ex id in integer ipso labore leo magna massa mi minim nam nec non nulla nunc officia porta quam qui quis sed sem si sit sunt tellus ut vel velit".split())
_TELLING = _PLACEHOLDING - _ORDINARY
_HERE = re.compile(r"\shere\b", re.I)
_TO_COME = re.compile(r"\W*(?:to ?do|tb[da]|fixme|xxx|tk)", re.I)


def placeholders(text: str) -> list[str]:
    """Unfilled placeholders of one line, without those the line speaks about."""
    out = []
    for m in PLACEHOLDER.finditer(text):
        if m[0][0] in "#_" and _UPPER_ONLY.match(m[0]) and m[0].upper() != m[0]:
            continue
        if MENTION_BEFORE.search(text[max(0, m.start() - 40) : m.start()]) or MENTION_AFTER.search(text[m.end() : m.end() + 40]):
            continue
        # "write a field such as X in the ... file" and "a pattern like X in the ... guide stands for"
        out.append(m[0])
    return out


def _is_vocabulary(line: str) -> bool:
    """Whether a line is dummy Latin or made of filler words."""
    words = list(map(str.lower, _WORD.findall(line)))
    # Either test below needs this share of both vocabularies, so the lines it sets aside pass neither.
    if sum(map(_PLACEHOLDING.__contains__, words)) < 0.65 * len(words) or _TELLING.isdisjoint(words):
        return False
    latin, nonsense = (sum(map(v.__contains__, words)) for v in (DUMMY_LATIN, NONSENSE))
    return (len(words) >= 4 and latin >= 0.65 * len(words)) or (len(words) >= 2 and nonsense >= 0.8 * len(words))


def _is_instruction(line: str) -> bool:
    """Whether a line says that text is still to come. What each branch of FILLER must hold is sought first."""
    low = line.lower()
    held = ("here" in low and _HERE.search(line)) or "this is a" in low or "click" in low or "with your own" in low or _TO_COME.match(line)
    return bool(held) and FILLER.search(line) is not None


def is_filler(line: str) -> bool:
    return _is_vocabulary(line) or _is_instruction(line)


def _terms(text: str | None) -> set[str]:
    return {w.lower() for w in _WORD.findall(text or "") if len(w) > 2}


def _bare(text: str) -> str:
    return _NOT_ALNUM.sub("", text.casefold())


_SIGNS = re.compile(r"[{}%@\[\]#_<$|]")
_CLAUSE_END = re.compile(r"[.!?…。！？]+(?:\s|$)|\.{2,}|[,;:、，：]\s*")
_MACHINE = re.compile(r"[\d/_\\@]")
_NOT_WORD = re.compile(r"[^\w#]+")
_ENDED = frozenset(".!?…。！？")


def clauses_of(line: str) -> list[str]:
    """Clauses of a line in lower case, without punctuation; tokens with digits, paths and the like are masked."""
    out = []
    for piece in _CLAUSE_END.split(line):
        if _MACHINE.search(piece):
            piece = " ".join("#" if _MACHINE.search(w) else w for w in piece.split())
        words = _NOT_WORD.sub(" ", piece).strip().casefold()
        if words and words.strip("# "):
            out.append(words)
    return out


def clause_key(clause: str) -> int:
    return xxhash.xxh3_64_intdigest(clause.encode("utf-8", "surrogatepass")) - 2**63


def own_lines(title: str | None, domain: str | None, lines: list[str]) -> list[tuple[str, bool]]:
    """(line, is heading) of a body without lines that repeat the title or the site's name; all lines if nothing else is left."""
    brand = _bare(re.sub(r"(?:-\d+)?\.\w+$", "", domain or ""))
    heading = _bare(_CODE.sub("", title or ""))
    longest = len(title or "") + len(domain or "")
    kept = []
    for x in lines:
        if len(x) <= longest:
            flat = _bare(_CODE.sub("", x))
            if flat and (flat == brand or (len(flat) > 6 and flat in heading)):
                continue
        kept.append(x)
    kept = kept or lines
    return [(x, k == 0 and len(kept) > 1 and x.rstrip()[-1] not in _ENDED) for k, x in enumerate(kept)]


def detected(title: str | None, lines: list[str]) -> tuple[int, int]:
    """How many placeholders, and how many lines of filler."""
    every = [title or "", *lines]
    residue = sum(len(placeholders(x)) for x in every if _SIGNS.search(x))
    # Words of the vocabularies that tell are sought in the whole page first.
    told = not _TELLING.isdisjoint(_WORD.findall("\n".join(every).lower()))
    return residue, sum((told and _is_vocabulary(x)) or _is_instruction(x) for x in every)


def mismatches(url: str | None, title: str | None, body: list[tuple[str, bool]]) -> tuple[bool, bool]:
    """Whether the last part of the address shares no term with the body's sentences, and none with the title."""
    path = re.sub(r"^\w+://[^/]*|[?#].*$", "", url or "").rstrip("/").rsplit("/", 1)[-1]
    slug = _terms(path.replace("-", " "))
    return not slug & _terms(" ".join(x for x, heading in body if not heading)), not slug & _terms(title)


def lines_of(body: str | None) -> list[str]:
    return [line for line in (body or "").split("\n") if line and not line.isspace()]


def _pages_schema() -> str:
    clause = "array<struct<key:bigint,size:int,heading:boolean,noted:boolean>>"
    return f"page_id long, domain string, residue int, filler int, slug_mismatch boolean, title_mismatch boolean, failed boolean, long boolean, clauses {clause}"


def measure(url: str | None, domain: str | None, title: str | None, body: str | None, status: int | None) -> dict:
    """What one page shows by itself. Only teaching responses carry their clauses; longer ones are read again once those are known."""
    lines = lines_of(body)
    residue, filler = detected(title, lines)
    long = len((body or "").split()) > TEACHING_WORDS
    own = []
    if lines and (not long or sum(len(x.split()) for x in lines if len(x) > len(title or "") + len(domain or "")) <= TEACHING_WORDS):
        own = own_lines(title, domain, lines)
        long = sum(len(x.split()) for x, _ in own) > TEACHING_WORDS
    out = {"residue": residue, "filler": filler, "slug_mismatch": False, "title_mismatch": False, "failed": (status or 0) >= 400, "long": long, "clauses": []}
    if not long:
        out["slug_mismatch"], out["title_mismatch"] = mismatches(url, title, own)
        for line, heading in own:
            noted = _is_notice(line)
            out["clauses"] += [{"key": clause_key(x), "size": len(x), "heading": heading, "noted": noted} for x in clauses_of(line)]
    return out


def _is_notice(line: str) -> bool:
    return (NOTICE.search(line) is not None or LOADING.match(line) is not None) and SPOKEN_OF.search(line) is None


def familiar_text(title: str | None, domain: str | None, body: str | None, familiar: frozenset) -> float:
    """Share of a long page's own text that familiar clauses make up; 0 as soon as it cannot reach half any more."""
    lines = lines_of(body)
    half = sum(map(len, lines)) / 2
    own, known, unknown = own_lines(title, domain, lines), 0, 0
    for line, heading in own:
        for x in clauses_of(line):
            if clause_key(x) in familiar:
                known += len(x)
            elif not heading:
                unknown += len(x)
        if unknown > half:
            return 0.0
    return known / (known + unknown) if known else 0.0


def _familiar(taught: DataFrame) -> DataFrame:
    """(key, addresses, hosts): the clauses of teaching responses that recur. As each stands on a set share of those responses, their
    number is bounded by the clauses a response holds over that share, whatever the corpus."""
    each = taught.select("domain", F.explode(F.array_distinct(F.col("clauses.key"))).alias("key"))
    hosts = each.groupBy("key", "domain").agg(F.count("*").alias("n"))
    counted = hosts.groupBy("key").agg(F.sum("n").alias("addresses"), F.count("*").alias("hosts"))
    least = max(LEAST_ADDRESSES, taught.count() * FAMILIAR_SHARE)
    return counted.where(F.col("addresses") >= F.when(F.col("hosts") >= LEAST_HOSTS, least).otherwise(3 * least)).select("key", "addresses", "hosts")


def evidence(pages: DataFrame) -> DataFrame:
    """One row per page_id: residue and filler (how many detectors hit), familiar (share of its own text in familiar clauses),
    addresses and hosts (of its most widespread clause), slug_mismatch, title_mismatch, failed (an error status), noted, score,
    and excluded.

    Null page_ids are dropped, redelivered rows count once; null or blank titles and bodies give no
    evidence; an empty body alone is never excluded. An empty table gives an empty result.
    """
    schema = _pages_schema()
    names = ["residue", "filler", "slug_mismatch", "title_mismatch", "failed", "long", "clauses"]
    columns = ["url", "domain", "title", "body_text", "status"]

    def over(c: dict[str, list]) -> dict[str, list]:
        rows = [measure(*x) for x in zip(*(c[k] for k in columns))]
        return {"page_id": c["page_id"], "domain": c["domain"]} | {k: [r[k] for r in rows] for k in names}

    given = pages.where(F.col("page_id").isNotNull())
    # Deliveries of a page are equal, so what was measured is deduplicated rather than the texts.
    measured = written(one_delivery(map_rows(given.select("page_id", *columns), over, schema), "page_id", ["domain", *names]), "residue")
    familiar = written(_familiar(measured.where(~F.col("long") & (F.size("clauses") > 0))), "familiar-clauses")
    clause = measured.where(F.size("clauses") > 0).select("page_id", F.explode("clauses").alias("c")).select("page_id", "c.*").join(familiar, "key", "left")
    known = F.when(F.col("addresses").isNotNull(), 1.0).otherwise(0.0)
    least = F.greatest(known, F.col("noted").cast("double") * (NOTICE_WEIGHT + F.lit(1 / LEAST_ADDRESSES)))
    weight = F.sum(F.col("size") * least)
    unknown = F.sum(F.when(~F.col("heading"), F.col("size") * (1 - least)).otherwise(0.0))
    short = clause.groupBy("page_id").agg(
        F.coalesce(weight / F.nullif(weight + unknown, F.lit(0.0)), F.lit(0.0)).alias("familiar"),
        F.max("addresses").alias("addresses"), F.max("hosts").alias("hosts"), F.max("noted").alias("noted"),
    )
    # At most TEACHING_WORDS / FAMILIAR_SHARE keys, see _familiar.
    keys = pages.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in familiar.select("key").collect()))

    def again(c: dict[str, list]) -> dict[str, list]:
        rows = []
        for key, url, domain, title, body in zip(*(c[k] for k in ("page_id", "url", "domain", "title", "body_text"))):
            share = familiar_text(title, domain, body, keys.value)
            if share:
                rows.append((key, share, *mismatches(url, title, own_lines(title, domain, lines_of(body)))))
        return dict(zip(("page_id", "familiar", "slug", "head"), map(list, zip(*rows)))) if rows else {"page_id": [], "familiar": [], "slug": [], "head": []}

    longer = given.where(F.length("body_text") > 2 * TEACHING_WORDS).select("page_id", "url", "domain", "title", "body_text")
    longer = one_delivery(map_rows(longer, again, "page_id long, familiar double, slug boolean, head boolean"), "page_id", ["familiar", "slug", "head"])
    longer = longer.join(measured.where("long").select("page_id"), "page_id", "left_semi")
    both = short.withColumns({"slug": F.lit(False), "head": F.lit(False)}).unionByName(longer, allowMissingColumns=True)
    joined = measured.drop("clauses", "long").join(both, "page_id", "left")
    joined = joined.withColumns({"slug_mismatch": F.col("slug_mismatch") | F.coalesce("slug", F.lit(False)), "title_mismatch": F.col("title_mismatch") | F.coalesce("head", F.lit(False))}).drop("slug", "head")
    joined = joined.na.fill(0, ["familiar", "addresses", "hosts"]).na.fill(False, ["noted"])
    flag = lambda name, weight: F.col(name).cast("double") * weight
    score = F.col("familiar") + flag("slug_mismatch", SLUG_WEIGHT) + flag("title_mismatch", TITLE_WEIGHT) + flag("failed", STATUS_WEIGHT)
    joined = joined.withColumn("score", F.when(F.col("familiar") > 0, score).otherwise(0.0))
    return joined.withColumn("excluded", (F.col("residue") > 0) | (F.col("filler") > 0) | (F.col("score") >= EXCLUDED_FROM))


def found(pages: DataFrame) -> DataFrame:
    return evidence(pages).where("excluded").select("page_id")
