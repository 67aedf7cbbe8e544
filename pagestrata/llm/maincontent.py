"""The main body of pages, without menus, notices, sidebars, teasers and footers.

A page is laid out as a sequence of visible blocks: pagestrata.llm.layout renders markup into blocks that know their
role; a body that is text already has one block a line and no roles. Four kinds of evidence then place each block, in this order:
layout (the block's elements lie outside the main content), recurrence (blocks that recur over a host's pages, digits and codes set aside,
are the host's furniture: counted over all its pages, which no single page can tell), words and shape of the block, and region (a run of headings
that carries teaser marks or follows a teaser caption is a teaser list, a heading beside body text is a heading).

Texts are read once: a page becomes one letter and one key a block, and all else works on these.
"""

from __future__ import annotations

import functools
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.layout import Block, blocks
from pagestrata.llm.rows import map_rows
from pagestrata.runtime import one_delivery, written

# Words of site navigation, by language.
NAVIGATION = frozenset(
    w.strip()
    for w in (
        "home, shop, store, stores, products, product, offers, deals, sale, guides, guide, blog, news, stories, events, press, careers, jobs, team, about, about us, contact, contact us, help, support, faq, faqs, search, "
        "login, log in, sign in, sign up, register, account, my account, basket, cart, bag, checkout, delivery, returns, shipping, terms, privacy, imprint, sitemap, cookies, accessibility, settings, menu, services, "
        "startseite, angebote, produkte, ratgeber, anmelden, warenkorb, versand, termine, hilfe, kontakt, suche, über uns, presse, karriere, filialen, rückgabe, impressum, datenschutz, agb, team, konto, neuigkeiten, "
        "inicio, tienda, tiendas, productos, ofertas, agenda, empleo, acceso, guías, ayuda, equipo, contacto, buscar, búsqueda, cesta, carrito, envíos, envío, devoluciones, prensa, noticias, nosotros, quiénes somos, aviso legal, privacidad, cuenta, "
        "accueil, boutique, magasins, produits, offres, agenda, emploi, emplois, connexion, conseils, guides, aide, équipe, contact, recherche, panier, livraison, retours, presse, actualités, à propos, mentions légales, confidentialité, compte, "
        "главная, магазин, магазины, товары, скидки, акции, события, вакансии, вход, войти, советы, помощь, команда, контакты, поиск, корзина, доставка, возврат, пресса, новости, о нас, условия, конфиденциальность, блог, "
        "ホーム, 店舗, 商品, 製品, ガイド, お知らせ, イベント, 採用, 採用情報, ログイン, ヘルプ, 会社概要, お問い合わせ, 検索, カート, 配送, 返品, プレス, ブログ, 利用規約, プライバシー"
    ).split(",")
)
# How furniture speaks, in short blocks.
FURNITURE_WORDS = re.compile(
    r"^skip to (?:content|main)|^back to top|^nach oben|^zum (?:inhalt|seitenanfang)|^volver arriba|^haut de page|^retour en haut|^наверх|^上へ戻る|^ページの先頭"
    r"|©|\(c\) ?\d{4}|\bcopyright\b|all rights reserved|alle rechte|todos los derechos|tous droits|все права|無断転載"
    r"|\bprivacy (?:policy|choices)|\bterms of use\b|registered office|prices include|delivery costs|preise inkl|precios (?:con|incl)|prix ttc|taxe comprise|impuestos? inclu|цены (?:с|включ)"
    r"|^(?:we take|we accept|zahlung|pago|paiement)\b.*(?:card|karte|tarjeta|carte)|customer line|made with care|web team"
    r"|^(?:accept|agree|allow|manage|reject) (?:all|and|selection|choices|cookies)\b|^only what is needed|^got it|^ok, understood|^alle annehmen|^verstanden|^ablehnen|^aceptar|^entendido|^accepter|^tout accepter|^compris|^принять|^понятно|^了解|^同意"
    r"|^share (?:this|on)|^send to a friend|^print\b|^teilen|^drucken|^seite teilen|^compartir|^enviar|^partager|^envoyer|^поделиться|^共有"
    r"|newsletter|^sign up (?:for|to)|^subscribe to|stock alerts|^abonn|boletín|^recevez|^suscr|рассылк|^подпис|新着メール|メールに登録"
    r"|^follow\b|^folgen sie|^siga a|^suivez|^следите|をフォロー|^download the\b|\bapp$|^app\b"
    r"|^sponsored\b|^advertisement$|^anzeige$|^publicidad$|^publicité$|^реклама$|^広告$|^gesponsert|^patrocinad|^sponsorisé"
    r"|^(?:tags?|schlagw\w+|etiquetas|étiquettes|mots[- ]clés|теги|метки|タグ)\s*[:：]|^(?:archive|archiv|archivo|archives|архив)\s*[:：]"
    r"|^rated \d|\bout of \d+ by\b|^opening hours|^öffnungszeiten|^horario|^horaires|^часы работы|^営業時間"
    r"|^(?:basket|cart|warenkorb|cesta|carrito|panier|корзина|カート)\s*\(",
    re.I,
)
# How consent notices speak; the second part keeps prose about cookies apart.
CONSENT = re.compile(r"cookies?\b|trackers?\b|privacy choices|speichert daten|enregistre|guarda datos|сохраня|куки|クッキー|情報を保存", re.I)
CONSENT_ACT = re.compile(
    r"\b(?:agree that|remember your|count visits|measure the pages|adverts|your (?:language|basket|device)|by staying|privacy choices|verwenden|speichert|wählen|zählen|usamos|contar|idioma|utilis\w+|enregistre\w*|visites|langue|используем|сохраня\w+)\b|を(?:覚える|数える|保存)", re.I
)
TEASER_CAPTION = re.compile(
    r"^(?:others? (?:also )?(?:viewed|liked|read)|you may also like|more (?:from|like this|stories)|most (?:read|viewed|popular)|read (?:next|more)|related\b|recommended|popular|trending|see also|keep reading"
    r"|meistgelesen|das k[öo]nnte|mehr (?:von|aus|zum)|auch interessant|weitere|lo más (?:leído|visto)|también|más de|le puede|les? plus lus?|à lire aussi|vous aimerez|plus de|à voir"
    r"|самое читаемое|читайте также|ещё от|еще от|вам может|похож|人気の記事|関連記事|あわせて読みたい|おすすめ)",
    re.I,
)
TEASER_MARK = re.compile(r"^\s*(?:→|»|›|>>|▸|►|⇒|read on\s*:|read more\s*:|next\s*:|more\s*:|weiterlesen\s*:|mehr\s*:|leer más\s*:|siga leyendo\s*:|lire\s*:|lire la suite\s*:|читать\s*:|далее\s*:|続き\s*[:：])|(?:→|»|›|>>|…»)\s*$|\(\d+ ?(?:min|mins|minutes|минут|мин|分)\.?\)\s*$|^\s*\d{1,2}\.\s+\S", re.I)
NUMBERED = re.compile(r"^\s*\d{1,2}\.\s+\S")
BULLET = re.compile(r"^\s*[-*•–—·‣◦]\s+")
SPLIT = re.compile(r"\s*(?:\||·|•|»|::|>|›)\s*|\s+/\s+|\s+[-–—]\s+")
END = (".", "!", "?", "。", "！", "？", "…", ".”", '."', "؟")

HOST_SHARE = 0.08
SMALL_HOST_SHARE = 0.3
LEAST_COPIES = 3
COPY_GROUP = 10
HEADING_WORDS = 14
TEASER_RUN = 8
_CODE = re.compile(r"\b[A-Z]{2}-\d+\b")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
_FIELD = re.compile(r"[^:]{2,24}:\s+\d")
_STRIPPED = re.compile(r"[\W_]+")


def site_name(domain: str | None) -> str:
    """The words of a host name, without a trailing number: 'bramble-kitchen-31.example' gives 'bramble kitchen'."""
    host = (domain or "").lower().removeprefix("www.")
    return " ".join(w for w in host.rsplit(".", 1)[0].split("-") if not w.isdigit())


@functools.lru_cache(maxsize=1 << 17)
def line_key(line: str) -> int:
    """A block up to digits, codes, letter case and spacing."""
    masked = _SPACE.sub(" ", _DIGITS.sub("9", _CODE.sub("#", line))).strip().casefold()
    return xxhash.xxh3_64_intdigest(masked.encode("utf-8", "surrogatepass")) - 2**63


def _flat(text: str) -> str:
    return _STRIPPED.sub("", text.casefold())


# One letter a block: blank, outside by its layout, furniture by its words, caption of teasers, marked teaser, heading, heading in the
# words of a caption, list item or table row, running text.
BLANK, OUTSIDE, FURNITURE, CAPTION, MARK, HEADING, CAPTION_HEADING, LIST, BODY = " ofcmhklb"


@functools.lru_cache(maxsize=1 << 17)
def shape(line: str) -> tuple[str, str]:
    """Letter of one block by its words and shape, and, of a trail that begins at a navigation word, its last part."""
    text = line.strip()
    if not text:
        return BLANK, ""
    words = text.split()
    n = len(words)
    cjk = n <= 3 and len(text) >= 12 and not text.isascii()
    sentence = text.endswith(END) and (n >= 4 or cjk)
    if sentence and n > 22:
        return BODY, ""
    if n <= 24 and CONSENT.search(text) and CONSENT_ACT.search(text):
        return FURNITURE, ""
    if n <= 22 and FURNITURE_WORDS.search(text) and not (sentence and n > 10 and text[:1] not in "©("):
        return FURNITURE, ""
    if n <= 9 and not sentence and TEASER_CAPTION.search(text):
        return CAPTION, ""
    tail = ""
    if not sentence:
        parts = [p.strip() for p in SPLIT.split(text) if p.strip()]
        if len(parts) >= 2:
            named = sum(p.casefold() in NAVIGATION for p in parts)
            if (named >= 2 and named >= 0.5 * len(parts)) or (len(parts) >= 3 and parts[0].casefold() in NAVIGATION):
                return FURNITURE, ""
            if parts[0].casefold() in NAVIGATION:
                tail = _flat(parts[-1])
        if n >= 3 and sum(w.casefold() in NAVIGATION for w in words) >= 0.7 * n:
            return FURNITURE, ""
    if text.casefold() in NAVIGATION:
        return FURNITURE, ""
    if BULLET.match(text):
        return LIST, tail
    if sentence or n > HEADING_WORDS:
        return BODY, tail
    if TEASER_MARK.search(text):
        return MARK, tail
    if _FIELD.match(text):
        return LIST, tail
    return (CAPTION_HEADING if TEASER_CAPTION.search(text) else HEADING), tail


def block_letter(block: Block, heading: str, site: str) -> str:
    """Letter of one block, its role and its page's title and site beside its own words."""
    if block.role == "outside":
        return OUTSIDE
    letter, tail = shape(block.text)
    if tail and (tail == site or tail in heading):
        return FURNITURE
    if letter in (BLANK, FURNITURE, CAPTION):
        return letter
    return {"heading": HEADING, "list": LIST, "table": LIST}.get(block.role, letter)


def laid_out(body: str | None, title: str | None, domain: str | None) -> tuple[str, list[int]]:
    """Letters and keys of a body's blocks, in order."""
    site, heading = _flat(site_name(domain)), _flat(_CODE.sub("", title or ""))
    found = blocks(body or "")
    return "".join(block_letter(b, heading, site) for b in found), [line_key(b.text) for b in found]


def outside_main(letters: str, keys: list[int], recurring) -> list[tuple[int, str]]:
    """(number from 1, evidence) of the blocks that are not main body. recurring(key) tells whether a block is furniture of the host."""
    kinds, why = list(letters), {}
    for k, letter in enumerate(letters):
        if letter == OUTSIDE:
            why[k] = "layout"
        elif letter != BLANK and recurring(keys[k]):
            why[k] = "recurrence"
            if letter != CAPTION:
                kinds[k] = CAPTION if letter == CAPTION_HEADING else FURNITURE
        elif letter in (FURNITURE, CAPTION):
            why[k] = "words"
    title_like = (HEADING, CAPTION_HEADING, MARK)
    aside = (OUTSIDE, FURNITURE)
    i = 0
    while i < len(kinds):
        if kinds[i] not in title_like:
            i += 1
            continue
        j = i
        while j < len(kinds) and kinds[j] in title_like:
            j += 1
        run = range(i, j)
        marks = [r for r in run if kinds[r] == MARK]
        before = next((kinds[r] for r in range(i - 1, -1, -1) if kinds[r] != BLANK), "")
        after = next((kinds[r] for r in range(j, len(kinds)) if kinds[r] != BLANK), "")
        teasers: set[int] = set()
        if len(run) > TEASER_RUN:
            # A listing of the page's own: marked lines are teasers all the same, and so is what stands
            # between a caption and the marks right after it.
            teasers.update(marks)
            near = [r for r in marks if r < i + TEASER_RUN]
            if before == CAPTION and near:
                teasers.update(range(i, near[-1] + 1))
        elif before == CAPTION:
            teasers.update(run)
        elif marks:
            first, last = marks[0], marks[-1]
            teasers.update(range(first, last + 1))
            # Unmarked neighbours belong to the teasers if furniture lies on their other side.
            if before in aside:
                teasers.update(range(i, first))
            if after in aside:
                teasers.update(range(last + 1, j))
        why.update((r, "region") for r in teasers)
        i = j
    return sorted((k + 1, w) for k, w in why.items())


def _limit(pages_of_host):
    """Copies from which a block is the host's furniture: a share of its pages, more than a group of copied pages may hold."""
    small = F.least(F.lit(float(COPY_GROUP)), pages_of_host * SMALL_HOST_SHARE)
    return F.greatest(F.lit(float(LEAST_COPIES)), small, pages_of_host * HOST_SHARE)


# Up to this many keys in all, the recurring blocks travel with the tasks; beyond it pages are joined to them.
CARRIED_KEYS = 500_000
HOST_PART = 20_000


def _lettered(pages: DataFrame) -> DataFrame:
    """(page_id, domain, letters, keys) of each page with a body, each page once."""

    def over(c: dict[str, list]) -> dict[str, list]:
        laid = [laid_out(b, t, d) for b, t, d in zip(c["body_text"], c["title"], c["domain"])]
        return {"page_id": c["page_id"], "domain": c["domain"], "letters": [x for x, _ in laid], "keys": [k for _, k in laid]}

    chosen = pages.where(F.col("page_id").isNotNull() & (F.length("body_text") > 0)).select("page_id", F.coalesce("domain", F.lit("")).alias("domain"), "title", "body_text")
    return one_delivery(map_rows(chosen, over, "page_id long, domain string, letters string, keys array<long>"), "page_id", ["domain", "letters", "keys"])


def recurring_blocks(lettered: DataFrame) -> DataFrame:
    """(domain, keys ARRAY<BIGINT>): the blocks that recur on each host, counted over all its pages.

    Counts combine before the shuffle, so a host with most of the pages sends few rows. A host keeps at most
    (blocks a page) / HOST_SHARE keys.
    """
    own = F.array_distinct(F.filter("keys", lambda k, i: F.substring(F.col("letters"), i + 1, F.lit(1)) != BLANK))
    counted = lettered.select("domain", F.explode(own).alias("key")).groupBy("domain", "key").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COPIES)
    hosts = lettered.groupBy("domain").agg(F.count("*").alias("pages"))
    return counted.join(hosts, "domain").where(F.col("n") >= _limit(F.col("pages"))).groupBy("domain").agg(F.collect_list("key").alias("keys"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, evidence): the blocks of each page that are not main body, counted from 1, and which evidence placed them.

    A block is a line of a text, or what layout.blocks renders of markup. pages has page_id, domain, title and body_text. Redelivered rows
    count once. Null or empty bodies give nothing; null domains and titles only weaken the evidence. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    lettered = written(_lettered(pages), "page-blocks")
    recurring = written(recurring_blocks(lettered), "recurring-blocks")
    schema = "page_id long, outside array<struct<line_no:int,evidence:string>>"
    total = recurring.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]

    def placed(letters: str, keys: list[int], known) -> list[dict]:
        return [{"line_no": k, "evidence": why} for k, why in outside_main(letters, keys, known)]

    if total <= CARRIED_KEYS:
        carried = spark.sparkContext.broadcast({r["domain"]: frozenset(r["keys"]) for r in recurring.collect()})

        def over(c: dict[str, list]) -> dict[str, list]:
            of = carried.value
            return {"page_id": c["page_id"], "outside": [placed(x, k, of.get(d, frozenset()).__contains__) for x, k, d in zip(c["letters"], c["keys"], c["domain"])]}

        found = map_rows(lettered, over, schema)
    else:
        # Too many hosts to carry: co-locate pages with their host's keys, large hosts in several parts.
        parts = lettered.groupBy("domain").agg(F.ceil(F.count("*") / HOST_PART).cast("int").alias("parts"))
        keyed = recurring.join(parts, "domain").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        split = lettered.join(parts, "domain").withColumn("part", F.pmod(F.xxhash64("page_id"), F.col("parts")).cast("int"))
        joined = split.join(keyed.select("domain", "part", F.col("keys").alias("host_keys")), ["domain", "part"], "left").select("page_id", "letters", "keys", "host_keys")

        def with_keys(c: dict[str, list]) -> dict[str, list]:
            return {"page_id": c["page_id"], "outside": [placed(x, k, frozenset(h or ()).__contains__) for x, k, h in zip(c["letters"], c["keys"], c["host_keys"])]}

        found = map_rows(joined, with_keys, schema)
    return found.select("page_id", F.explode("outside").alias("o")).select("page_id", "o.line_no", "o.evidence")


def main_body(pages: DataFrame) -> DataFrame:
    """(page_id, main_text, main_word_count) of each page with a body, each page once: its blocks but those of page_blocks, one a line."""
    outside = page_blocks(pages).groupBy("page_id").agg(F.collect_list("line_no").alias("outside"))
    once = one_delivery(pages.where(F.length("body_text") > 0), "page_id", ["body_text"])

    def over(c: dict[str, list]) -> dict[str, list]:
        texts = []
        for body, out in zip(c["body_text"], c["outside"]):
            left = frozenset(out or ())
            texts.append("\n".join(b.text for k, b in enumerate(blocks(body), 1) if k not in left))
        return {"page_id": c["page_id"], "main_text": texts, "main_word_count": [len(t.split()) for t in texts]}

    return map_rows(once.join(outside, "page_id", "left"), over, "page_id long, main_text string, main_word_count int")


def found(pages: DataFrame) -> DataFrame:
    return page_blocks(pages.where((F.col("status") == 200) & (F.col("word_count") >= 120))).select("page_id", "line_no")
