"""Problem 9: template residue, filler text, error pages and script notices."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from re import _constants as sre
from re._parser import parse as sre_parse

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import spread, stage

try:
    import ahocorasick
except ImportError:  # the strings are then looked up one by one
    ahocorasick = None

#: A message counts as widely recurring from this many sites and documents on.
SITES, DOCUMENTS = 2, 2
#: Words of the opening by which sentences put together from parts are grouped, too.
OPENING = 4

# Names of fields in templates of the domain, in the languages of the corpus.
FIELDS = (
    "title|paper title|titles|abstract|author|authors|author name|author names|first author|last author|name|names|full name|venue|journal|conference|year|date|month|day|doi|url|link|topic|keyword|keywords|"
    "dataset|data set|method|method name|model|model name|baseline|metric|metrics|score|section|section title|heading|affiliation|institution|university|city|country|email|reviewer|editor|field|field of study|"
    "fields|result|results|result table|table|figure|n citations|citations|citation count|paper|paper id|arxiv id|summary|description|text|content|volume|pages|number|task|domain|placeholder|value|reference|references|license|licence|"
    "titel|autor|autoren|autorname|name des autors|name der methode|methode|methodenname|jahr|datensatz|zusammenfassung|thema|zeitschrift|"
    "titre|auteur|auteurs|nom de l auteur|nom de la methode|annee|jeu de donnees|resume|sujet|revue|"
    "titulo|autores|nombre del autor|nombre del metodo|metodo|ano|conjunto de datos|resumen|tema|revista|"
    "nome do autor|nome do metodo|conjunto de dados|resumo|assunto|"
    "название|название статьи|название метода|автор|имя автора|авторы|год|набор данных|аннотация|тема|метод|журнал|"
    "年份|年|作者|作者姓名|标题|论文标题|方法|方法名称|数据集|摘要|主题|期刊|著者|著者名|タイトル|題名|論文タイトル|手法|手法名|データセット|要旨|概要|発行年|年度"
)
# Words around a field name that ask to fill it.
ASKS = (
    "请输入|请填写|请|してください|ください|insert|enter|add|type|fill in|fill|your|the|here|goes here|tbd|tba|todo|to do|fixme|xxx|please|put|name of|paste|provide|"
    "einfugen|hier|eingeben|bitte|ihr|ihre|inserer|ici|saisir|votre|entrer|insertar|aqui|su|escribir|introducir|inserir|seu|sua|digitar|вставить|вставьте|укажите|введите|здесь|插入|填写|在此|输入|此处|入力|挿入|ここ"
)
# Beginnings of the words of the usual Latin filler passage.
LATIN = frozenset(
    "lore ipsu dolo sita amet cons adip elit elis sed sedo eius temp inci inve tinv labo labi magn aliq enim veni mini mina nost exer ulla nisi nisu comm duis aute irur repr volu veli esse cill fugi null exce sint occa cupi prov culp offi dese moll anim quis pari labor etdo etor".split()
)
# Words of nonsense filler.
NONSENSE = frozenset("blah bla text test xxx asdf qwer jkl jklo qwerty sdf dfg hjkl foo bar baz foobar lorem ipsum dummy sample blindtext texto texte testing yada etc".split())

_FIELD_SET = frozenset(FIELDS.split("|"))
_ASK_SET = frozenset(ASKS.split("|"))
_ASK_WORDS = sorted(_ASK_SET, key=len, reverse=True)
_INNER = r"([^\[\]{}<>«»%@|~\n]{1,60}?)"
_SLOTS = re.compile(
    "|".join(
        [
            r"\$?\{\{\{?\s*" + _INNER + r"\s*\}?\}\}",
            r"[$#]\{\s*" + _INNER + r"\s*\}",
            r"<%=?\s*" + _INNER + r"\s*%>",
            r"\{%\s*" + _INNER + r"\s*%\}",
            r"<<\s*" + _INNER + r"\s*>>",
            r"\[\[\s*" + _INNER + r"\s*\]\]",
            r"&lt;\s*" + _INNER + r"\s*&gt;",
            r"<\s*" + _INNER + r"\s*>",
            r"\{\s*" + _INNER + r"\s*\}",
            r"\[\s*" + _INNER + r"\s*\](?!\()",
            r"«\s*" + _INNER + r"\s*»",
            r"@@\s*" + _INNER + r"\s*@@",
            r"(?<![A-Za-z0-9%])%\s?([A-Za-z][\w .]{1,40}?)\s?%(?![A-Za-z0-9])",
            r"(?<![A-Za-z0-9_])__+\s?([^\W_][^\n]{0,40}?)\s?__+(?![A-Za-z0-9_])",
            r"(?<![A-Za-z0-9~])~\s?([^\W\d][\w .\-]{1,40}?)\s?~(?![A-Za-z0-9])",
            r"(?<![A-Za-z0-9|])\|([^\W\d][\w. ]{1,40})\|(?![A-Za-z0-9|])",
            r"\(([^()\n]{1,60}?)\)_{2,}",
            r"\(\s*((?:your|insert|enter|add)\s[^()\n]{1,50}?)\)",
        ]
    )
)
# Slots by their syntax alone, whatever the field is called: template expressions around an identifier, and brackets that ask.
_IDENTIFIER = r"[^\W\d_]\w*(?:[ .\-]\w+){0,4}"
_SYNTAX = re.compile(
    "|".join(
        [
            r"\{\{\s*" + _IDENTIFIER + r"\s*\}\}",
            r"\$\{\s*" + _IDENTIFIER + r"\s*\}",
            r"<%=?\s*" + _IDENTIFIER + r"\s*%>",
            r"\{%\s*" + _IDENTIFIER + r"\s*%\}",
            r"(?<![\w\\^_$])\{[a-z]+(?:_[a-z]+)+\}",
            r"[\[<](?i:insert|enter|add|your|todo|tbd|please)\b[^\[\]<>\n]{1,60}[\]>](?!\()",
        ]
    )
)
_DELIMITERS = ("[", "{", "<", "@", "~", "|", "%", "__", "&lt;", "«")
_ASKING = re.compile(r"\((?:your|insert|enter|add)\s", re.I)
_NUMBERED = re.compile(r"^\W*\[\d+\]")
_BAD = ("[object", "#N/A", "#REF", "#VALUE", "null", "undefined", "NaN", "None", "nil")
_MENTION = re.compile(
    r"\b(such as|tokens? like|fields? like|markers? like|written as|denotes?|denoted|e\.g\.|for example|for instance|stands? for|called|spelled|tags?|macros?|markers?|column|grammar|syntax|slots?|sentence frame|"
    r"placeholders? (in|are|were|of|that|like)|template engines?|regular expression|templates? (such|like|with|whose|are|were)|marked (a |the )?\w+ as|escape|quoted|wie etwa|zum beispiel|par exemple|por ejemplo|por exemplo|например|例如)\b",
    re.I,
)
_BAD_FILL = re.compile(r"\[object Object\]|#N/A|#REF!|#VALUE!|\(null\)|(?<![\w.])(?:undefined|NaN|null|None|nil)(?![\w.]*\w)")
_LABELLED_FILL = re.compile(r"\b(title|authors?|venue|year|doi|abstract|journal|volume|pages|cited|published in|dear|by|topic|keywords?|score of|showing|query)\b\s*:?\s*[\"“(]?(\[object Object\]|#N/A|#REF!|\(null\)|undefined|NaN|null|nil)(?!\w)", re.I)

_NONE_FILL = re.compile(r"\b[Cc]ited None times|\b(?:Title|Authors?|Venue|Year|Doi|DOI|Abstract)\s*:\s*None\b")

# Messages: patterns for a whole segment; they start where the segment starts.
_SCRIPT = r"(java\s?script|js|scripts?|scripting|script execution|active content|client-side (code|scripting|scripts)|browser scripts?)"
_MESSAGES = [
    # script notices
    rf"^(?:\W|please |veuillez |noscript:? ?|warning:? |notice:? |to continue,? |sorry,? )*(?:please )?(?:enable|activate|turn on|switch on|allow)\b.{{0,30}}\b{_SCRIPT}\b",
    rf"^.{{0,60}}\b(?:you (?:need|have) to|you must|please|if nothing appears,?|kindly) (?:enable|activate|turn on|switch on|allow)\b.{{0,30}}\b{_SCRIPT}\b",
    rf"^{_SCRIPT}(?: and cookies)? (?:is|are|has to be|have to be|must be|needs? to be|seems? to be|appears? to be|could not be|cannot be|was not)\b.{{0,20}}\b(?:disabled|enabled|needed|required|blocked|switched off|turned off|turned on|allowed|supported|started|accepted|off|activated|available)\b",
    rf"^(?:this|the|our) (?:site|page|website|app|application|viewer|reader|library|archive|portal|service|article) (?:requires?|needs?|relies on|depends on|uses|only works with|does not work without)\b.{{0,30}}\b{_SCRIPT}\b",
    rf"^cookies (?:must be|have to be|need to be|are (?:needed|required)|and {_SCRIPT} (?:must|are required|are needed|have to))",
    rf"^(?:sorry,? )?.{{0,50}}\b(?:cannot|can't|can not|will not|won't|does not|unable to) (?:run|load|work|be shown|be displayed|display|start)\b.{{0,30}}\bwithout {_SCRIPT}",
    r"^noscript\b",
    r"^.{0,20}\bjavascript\b.{0,60}\b(aktivieren|einschalten|activer|activez|habilit\w*|activ[ae]\w*|ative|ativar|deaktiviert|désactivé|desactivado|desativado)",
    r"^.{0,12}\b(aktivieren sie|bitte aktivieren|veuillez activer|activez|habilite|active|ative|habilita)\b.{0,20}\bjavascript",
    r"^.{0,20}(включите|разрешите|необходимо включить)\b.{0,20}(javascript|скрипт|сценар)|javascript.{0,30}(отключ|включ|требуется)",
    r"请(启用|开启|打开|允许)\s*(javascript|脚本)|(javascript|脚本)\s*(已禁用|被禁用|未启用|を有効に|が無効|を有効化)|スクリプト.{0,12}(有効|許可)",
    # error pages
    r"^(?:\W|http(?:/\d(?:\.\d)?)? ?|error:? ?|fehler:? ?|erreur:? ?|ошибка:? ?|erro:? ?|status:? ?|code:? ?|错误[:：]? ?|エラー:? ?|warning:? ?|fatal:? ?|request failed:? ?|unavailable:? ?)*(?:[45]\d\d)\b\W*(?:not found|forbidden|bad gateway|bad request|unauthori[sz]ed|gone|internal server error|service (?:temporarily )?unavailable|gateway time-?out(?!s)|request time-?out(?!s)|too many requests|$|no se|la página|la page|die (?:seite|angeforderte)|страница|页面|ページ|página|pagina|the |this |no |sorry|access|page|an? |database|your |too |request|security)",
    r"^err_\w+|^(?:unavailable|forbidden|gone|error|warning|fatal error|request failed|notice)\s+[-–—]\s+\w",
    r"^(?:\W|sorry\b)*the full text is not available|^we are moving the archive",
    r"^internal server error\W*$|^(?:oops|whoops|uh-?oh)\b\W|^sorry\s*[-–—:.!]\s",
    r"^\(?(?:error|http|fehler|erreur|ошибка|erro|status) [45]\d\d\)?\W*$",
    r"^http/\d(?:\.\d)? [45]\d\d\b",
    r"^\(?[45]\d\d (?:not found|forbidden|bad gateway|gone|service unavailable|internal server error|gateway time-?out|unauthori[sz]ed|bad request)\)?\.?$",
    r"^(?:\W|error:? |unavailable:? ?[-–]? ?|warning:? ?[-–]? ?|fatal error:? ?[-–]? ?|request failed:? ?[-–]? ?)*access (?:to this (?:page|document|resource|article) )?(?:is |was |has been )?denied\W*(?:you|$)",
    r"^.{0,60}\b(?:you do not have permission|you are not authori[sz]ed|your account lacks the rights|you don't have access)\b",
    r"^(?:\W|sorry,? |oops[,!.]* ?)*(?:something went wrong|an (?:unexpected |unknown |internal )(?:error|condition) (?:has )?(?:occurred|stopped))",
    r"^(?:\W|request failed:? ?|warning:? ?[-–]? ?)*an unexpected condition stopped",
    r"^sqlstate\[|^(?:database|mysql|postgres\w*|db) (?:connection )?(?:error|failed|connection failed)|database connection failed",
    r"^(?:traceback \(most recent call last\)|(?:java|javax|org|com|net)\.[\w.$]+(?:exception|error)\b|exception in thread|fatal error:? ?(?:$|uncaught|call)|segmentation fault|uncaught (?:type|reference|syntax)?error|warning: \w+\(\))",
    r"^\s*at [\w.$]+\([\w.]+:\d+\)",
    r"^(?:the )?(?:upstream|search|paper|origin|remote|archive|index|backend|gateway) ?(?:server|index|backend|service)? (?:closed the connection|did not answer|returned no answer|timed out|is not responding|returned an error)",
    r"^gateway time-?out(?!s)",
    r"^(?:sorry,? )?(?:the|this) (?:requested )?(?:page|paper|document|article|record|file|resource|item|url|address|link|preprint)(?: you (?:are looking for|asked for|requested))?(?: either)? (?:could not be (?:located|found|loaded)|cannot be found|was not found|has moved|no longer exists|does not exist|was removed|has been removed|has expired|was typed incorrectly|is not available|is unavailable|has been deleted)",
    r"^(?:\W|sorry,? |warning:? ?[-–]? ?|http \d+ ?[-–]? ?|fatal error ?[-–]? ?)*(?:the address was typed incorrectly|the record you asked for was removed|this link has expired|the security token did not match|your session has (?:expired|timed out)|session expired|too many (?:readers|users|requests|visitors) are connected|too many requests)",
    r"^(?:this|the|our) (?:preprint |paper |search |web)?(?:server|site|service|archive|system) is (?:temporarily |currently )?(?:down|unavailable|offline|undergoing|under)\b",
    r"^(?:error:? ?\d*:? ?)?(?:the )?service (?:is )?(?:temporarily|currently) unavailable",
    r"^(?:we could not (?:render|load|display|open|find)|unable to (?:load|display|render|open|connect)|failed to (?:load|fetch|connect|render)|(?:the )?pdf (?:converter|viewer|renderer) (?:ran out|failed|crashed|could not))",
    r"^please (?:confirm|verify|prove) that you are (?:not a robot|human|a human)|^(?:complete|solve) the captcha|^checking your browser",
    r"^(?:institutional )?log ?in required\b|^institutional (?:login|access) required",
    r"^(?:le (?:service|serveur) est|ce (?:service|serveur) est|la page (?:demandée|que vous)|page introuvable|accès refusé|accès interdit)|la page demandée est introuvable",
    r"^(?:der (?:dienst|server) ist|dieser (?:dienst|server) ist|die (?:angeforderte )?seite (?:wurde nicht|konnte nicht|ist nicht)|seite nicht gefunden|zugriff verweigert)",
    r"^(?:el (?:servicio|servidor) (?:no está|está)|(?:la )?página no encontrada|no se encontró la página|acceso denegado|acceso prohibido)|no se encontró la página solicitada",
    r"^(?:o (?:serviço|servidor) está|página não encontrada|a página (?:solicitada|que)|acesso negado)|página (?:solicitada )?não (?:foi )?encontrada",
    r"^(?:страница не найдена|доступ (?:запрещ|закрыт)|сервис (?:временно )?недоступен|сервер (?:временно )?недоступен)|запрашиваемая страница не найдена",
    r"(?:页面(?:不存在|未找到|无法|找不到)|找不到(?:该|您|请求的)?页面|服务(?:暂时)?不可用|访问被拒绝|拒绝访问|无法访问|请稍后(?:再试|重试)|ページが(?:見つか|存在)|アクセスが拒否|サービスは?現在利用|しばらくして(?:から)?(?:もう一度|再度))",
]
# Instructions of templates and stock filler: like an unfilled slot, one stands where content should be.
_INSTRUCTIONS = [
    r"^(?:please )?(?:replace|overwrite|delete) this (?:paragraph|text|section|sentence|line|placeholder)\b",
    r"^(?:a |the )?(?:short |brief )?(?:description|summary|abstract|text|content)\b.{0,40}\bwill (?:appear|be added|be inserted|go|follow) (?:in this space|here)",
    r"^this is (?:a )?(?:placeholder|dummy|sample|filler|example)(?: text| paragraph| content| abstract)?\b",
    r"^your (?:abstract|text|title|summary|content|introduction|paper title|name|conclusion|keywords) (?:goes|comes|belongs|should go|will appear|here)\b",
    r"^(?:abstract|text|content|summary|title|section)(?: content| text)? (?:to be (?:provided|added|written|supplied|inserted)|goes here|coming soon)\b",
    r"^(?:type|write|enter|insert|add|put) (?:something|your \w+|text|the \w+|content) here\b|^click (?:here )?to (?:edit|add)\b",
    r"^name of the institution, city|^first author name, second author name|^(?:author|authors?) names? (?:here|go here)",
    r"^(?:dummy|sample|placeholder|filler) (?:paragraph|text|abstract|sentence|abstract text|content)\b.{0,50}(?:\bused to\b|\.$|$)",
    r"^more text follows here|^text (?:goes |follows )here|^the quick (?:brown|grey|red|white|black) \w+ jumps\b",
    r"^(?:hier steht (?:ihr|der|dein) text|bitte ersetzen sie|hier (?:ihren?|den) \w+ einf|platzhalter(?:text)?\b)|blindtext blindtext",
    r"^(?:saisissez ici|texte provisoire|remplacez ce|insérez (?:ici|votre)|votre (?:texte|résumé) ici|faux texte)",
    r"^(?:escriba aquí|inserte (?:aquí|su)|reemplace este|sustituya este|texto (?:provisional|de relleno|de ejemplo)|aquí va (?:el|su))",
    r"^(?:escreva aqui|digite aqui|insira (?:aqui|seu|o)|substitua este|texto (?:provisório|de exemplo|de preenchimento)|aqui vai)",
    r"^(?:замените этот|здесь будет|вставьте (?:сюда|текст)|введите текст|текст-заполнитель|текст заполнитель)",
    r"(?:此处填写|请替换本段|在此(?:处)?(?:输入|填写|插入)|占位(?:文字|文本|符)|ここに(?:要旨|本文|テキスト|文章|概要)|この段落を(?:置き換え|書き換え)|ダミーテキスト|サンプルテキスト)",
]
# Words of pages that speak to their reader. A segment with one of them counts only as a message that recurs across sites.
_ADDRESS = re.compile(
    r"browser|reload|refresh|try again|again later|go back|help ?desk|administrator|sign in|log ?in\b|logged|cookies?\b|\bscripts?\b|scripting|javascript|\bserver\b|link is broken|broken link|web ?page|this page|the page|start page|home ?page|search form|"
    r"settings and|support team|contact (?:us|support|the)|quota|unusual activity|request id|incident|rights for|withdrawn|maintenance|temporarily|internal error|server error|instructions|delete (?:this|these)|placeholder|your (?:abstract|text|title|paper|summary|device|account|"
    r"address|download|connection|ip|institution|library|own|request|session)\b|\bclick|captcha|robot before|^loading|redirect|expired|unavailable|not found|document missing|report this problem|could not be (?:shown|displayed|opened|loaded|found|rendered)|here are some things|try again|no results|"
    r"request failed|fatal error|\boops\b|return to the|we apologi[sz]e|sorry|file may be damaged|check the identifier|plain version|choose your|public view|please |afterwards\.|not available in|search the library|request blocked|will not load|has them|\bhere\b.{0,30}(?:text|abstract|title|summary)|"
    r"(?:text|abstract|title|summary|paragraph)\b.{0,40}\bhere\b|skripte?n?\b|\bseite\b|interner fehler|erneut|versuchen sie|laden sie|anmelden|melden sie|zugriff|platzhalter|kennung|\bdienst\b|ihre[nr]? |bitte |navigateur|\bpage\b|serveur|erreur interne|réessay|recharg|connectez|accès|désactiv|votre |veuillez|"
    r"remplac|saisi|navegador|página|servidor|error interno|vuelva|inténtelo|intente|recargue|acceso|desactivad|reemplace|sustituya|por favor|erro interno|tente |recarregue|acesso|desativad|substitua|seu navegador|браузер|страниц|сервер|внутренняя ошибка|повторите|попробуйте|обновите|войдите|доступ |"
    r"скрипт|замените|введите|пожалуйста|浏览器|页面|服务器|内部错误|重试|再试|刷新|登录|访问|脚本|请|ブラウザ|ページ|サーバー|内部エラー|お試し|再読み込み|ログイン|アクセス|スクリプト|ください",
    re.I,
)
#: Words of papers that write about such things; with one of them a segment is no message.
_PAPER = re.compile(r"\b(we|our|percent|per cent|dataset|baseline|annotators?|experiments?|trials?|samples?|studies|study|were|condition|wir|nous|nos|estudiamos|investigamos|мы)\b|本研究|本文|我们", re.I)
# Names of methods and datasets, which no page of an archive's software would call by name.
_NAMED = re.compile(r"\b(?!JavaScript|NullPointer|Content-)[A-Z][a-z]+(?:[A-Z][A-Za-z]*|-[A-Z0-9]\w*|\+(?!\w))")
_QUOTED = re.compile(r"[\"“„][^\"“”„]{2,200}[\"”“]")
_SPLIT = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\s*\n+\s*|\s+\|\s+")
_TAGS = re.compile(r"(?<!<)</?(?:html|head|body|h\d|p|div|span|br|hr|b|i|em|strong|center|a|ul|li|pre|noscript|script|meta|style)\b[^<>]{0,80}>(?!>)", re.I)
_TITLE_TAG = re.compile(r"<title>([^<>]*)</title>", re.I)


def masked(segment: str) -> str:
    """A segment with numbers, addresses and dates masked, of one case and spacing, without a short lead-in and punctuation at its ends."""
    s = re.sub(r"^[^:–—]{2,30}?(?::|\s[-–—])\s+(?=\w)", "", unicodedata.normalize("NFKC", segment).lower())
    s = re.sub(r"https?://\S+|www\.\S+|\S+@\S+\.\w+", "<address>", s)
    s = re.sub(r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b|\b\d{1,2}:\d{2}(?::\d{2})?\b", "<date>", s)
    s = re.sub(r"\b[0-9a-f]{8,}\b", "<number>", s)
    s = re.sub(r"\d+(?:[.,]\d+)*", "<number>", s)
    return re.sub(r"\s+", " ", s).strip(" .!?-–—:;,()[]{}\"'*")


def required(tree) -> set[str] | None:
    """Strings of which any match of a parsed pattern holds at least one, caseless; None if the pattern tells of none."""
    best, run = None, ""

    def better(found: set[str] | None) -> None:
        nonlocal best
        if found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, arg in [*tree, (None, None)]:
        if op is sre.LITERAL:
            run += chr(arg).casefold()
            continue
        better({run} if run else None)
        run = ""
        if op is sre.BRANCH:
            parts = [required(b) for b in arg[1]]
            better(set().union(*parts) if all(parts) else None)
        elif op is sre.SUBPATTERN:
            better(required(arg[3]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            better(required(arg[2]))
    return best


class Rules:
    """Sets of caseless patterns behind one automaton of the strings they require: each runs only on segments that could match it.

    The strings are derived from the patterns, so nothing that a pattern matches is passed over.
    """

    def __init__(self, **sets: list[str]) -> None:
        self.compiled = {name: [re.compile(p, re.I) for p in patterns] for name, patterns in sets.items()}
        self.always: set[tuple[str, int]] = set()
        by_string = defaultdict(list)
        for name, patterns in sets.items():
            for i, p in enumerate(patterns):
                strings = required(sre_parse(p, re.I))
                if not strings or min(map(len, strings)) < 2:
                    self.always.add((name, i))
                for x in strings or ():
                    by_string[x].append((name, i))
        self.by_string = {x: tuple(which) for x, which in by_string.items()}
        self.automaton = None
        if ahocorasick:
            self.automaton = ahocorasick.Automaton()
            for x, which in self.by_string.items():
                self.automaton.add_word(x, which)
            self.automaton.make_automaton()

    def possible(self, text: str) -> set[tuple[str, int]]:
        """The patterns, as (set, number), that could match a text or a part of it."""
        low, found = text.casefold(), set(self.always)
        for which in [w for _, w in self.automaton.iter(low)] if self.automaton else [w for x, w in self.by_string.items() if x in low]:
            found.update(which)
        return found

    def holds(self, name: str, possible: set[tuple[str, int]], *texts: str) -> bool:
        """Whether a pattern of a set matches one of the texts, each a part of the one that ``possible`` is of."""
        return any(self.compiled[name][i].search(t) for of, i in possible if of == name for t in texts)


def branches(pattern: str) -> list[str]:
    """The alternatives of a pattern outside its groups."""
    out, depth, start, at = [], 0, 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "[":
            at = pattern.index("]", at + 2)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:at])
            start = at + 1
        at += 1
    return [*out, pattern[start:]]


RULES = Rules(strong=[b for p in _MESSAGES for b in branches(p)], instruction=[b for p in _INSTRUCTIONS for b in branches(p)], address=branches(_ADDRESS.pattern))


def asks_for_field(inner: str, whole: str = "") -> bool:
    """Whether what stands between the delimiters of a slot is a field name, with or without a request to fill it."""
    s = unicodedata.normalize("NFKD", inner)
    s = "".join(c for c in s if not unicodedata.combining(c) or c in "йё")
    s = re.sub(r"([a-z])([A-Z])|([A-Z])([A-Z][a-z])", lambda m: " ".join(g for g in m.groups() if g), s).lower()
    s = re.sub(r"[をのにはへ]", " ", s)
    s = re.sub(r"\b(?:paper|doc|record|item|data|entry|user)\.", "", s)
    s = re.sub(r"[_\-./:…\"'’]+", " ", s)
    s = re.sub(r"\s+", " ", re.sub(r"\d+", " ", s)).strip()
    if not s:
        return False
    if s in _FIELD_SET:
        return True
    t, asked = " " + s + " ", False
    for a in _ASK_WORDS:
        if " " + a + " " in t:
            t, asked = t.replace(" " + a + " ", " "), True
    if not asked:
        for a in _ASK_WORDS:
            if ord(a[0]) > 0x2E80 and a in t:
                t, asked = t.replace(a, " "), True
    rest = re.sub(r"^ ?(le|la|les|el|los|o|os|der|die|das|den|de|du|del|do|da|of|l) ", " ", t).strip()
    return asked and (not rest or rest in _FIELD_SET)


def has_slot(segment: str) -> bool:
    """Whether a segment holds an unfilled slot that it doesn't merely mention."""
    bare = _NUMBERED.sub("", segment) if "[" in segment else segment  # the number of a reference
    if not any(d in bare for d in _DELIMITERS) and not ("(" in bare and _ASKING.search(bare)):
        return False
    found = [m for m in _SLOTS.finditer(segment) if asks_for_field(next(g for g in m.groups() if g is not None))] + list(_SYNTAX.finditer(segment))
    if not found:
        return False
    if _MENTION.search(segment):
        return False
    quoted = [q.span() for q in _QUOTED.finditer(segment)]
    return any(not any(a <= m.start() and m.end() <= b for a, b in quoted) for m in found)


def is_filler(segment: str) -> bool:
    """Latin filler, nonsense, or one word over and over; as a whole, or in a run at the head of a longer segment."""
    quick = segment.lower().split()
    if len(quick) < 3:
        return False
    latin = sum(map(LATIN.__contains__, [w[:4] for w in quick]))
    if latin < 4 and not any(w.strip(".,;:!?") in NONSENSE or (w[0] in _X and set(w) <= _X) for w in quick):
        return False
    ws = re.findall(r"[^\W\d_]+", segment.lower())
    if len(ws) < 3:
        return False
    latin = sum(w[:4] in LATIN for w in ws)
    if len(ws) >= 4 and latin >= 0.6 * len(ws) and segment.isascii():
        return True
    odd = [w in NONSENSE or set(w) == {"x"} for w in ws]
    if all(set(w) == {"x"} for w in ws) or (sum(odd) >= 0.6 * len(ws) and (len(set(ws)) <= 0.75 * len(ws) or all(odd))):
        return True
    if any(sum(odd[k : k + 8]) >= 5 for k in range(max(1, len(ws) - 7))):
        return True
    if any(len(set(ws[k : k + 3])) == 1 and odd[k] for k in range(min(2, len(ws) - 2))):  # one word three times at the head
        return True
    run = 0
    for w in ws:
        run = run + 1 if w[:4] in LATIN and len(w) > 3 else 0
        if run >= 6:
            return True
    return False


_X = frozenset("x.,")
_INVISIBLE = regex.compile(r"\p{Cf}+")  # no ASCII character is one


def wrongly_filled(text: str) -> bool:
    """Values that stand for no value where a field should be: twice in a text, or after a field's label."""
    if not any(b in text for b in _BAD) or not _BAD_FILL.search(text):
        return False
    if _LABELLED_FILL.search(text) or _NONE_FILL.search(text):
        return True
    for seg in _SPLIT.split(text):
        found = _BAD_FILL.findall(_QUOTED.sub(" ", seg)) or []
        if "None" in found:
            found = _BAD_FILL.findall(seg)
        if len(found) >= 2 and len(set(found)) == 1 and (found[0] != "None" or len(found) >= 3) and not _MENTION.search(seg):
            return True
    return False


def segments(text: str) -> list[str]:
    """Sentences, lines and cells of a text, markup of pages removed."""
    t = html.unescape(text) if "&" in text and "&lt;" not in text else text
    if not t.isascii():
        t = _INVISIBLE.sub("", unicodedata.normalize("NFC", t))
    if "<" in t:
        t = _TAGS.sub("\n", _TITLE_TAG.sub(r"\n\1\n", t))
    t = t.replace("\r", "\n").replace("\xa0", " ").replace("　", " ")
    return [s.strip() for s in _SPLIT.split(t) if s and s.strip()]


def examine(text: str | None) -> tuple[bool, list[int]]:
    """Whether a text is residue by itself, and the hashes of its messages, which make it residue if they recur across sites.

    By itself speak unfilled or wrongly filled slots, instructions of templates, filler, and a message of
    unmistakable wording that has another beside it or is half of its page. A message is hashed masked; one of unmistakable wording also by its opening, as software puts
    sentences together from parts.
    """
    if not text or not text.strip():
        return False, []
    told, size, lines, sure = {}, 0, 0, False
    parts = segments(text)
    for s in parts:
        if has_slot(s) or is_filler(s):
            return True, []
        bare = _QUOTED.sub(" ", s) if len(s) > 60 else s
        head = bare.lstrip(" \t-–—*•·>#\"'([{")
        can = RULES.possible(bare)
        if RULES.holds("instruction", can, head, bare):
            return True, []
        if RULES.holds("strong", can, head, bare):
            whole = masked(s)
            ws = whole.split()
            told[xxhash.xxh3_64_intdigest(whole)] = None
            if len(ws) > OPENING:
                told[xxhash.xxh3_64_intdigest(" ".join(ws[:OPENING]) + " ...")] = None
            size, lines, sure = size + len(s), lines + 1, True
        elif RULES.holds("address", can, bare) and not _PAPER.search(s) and not _NAMED.search(s) and not _MENTION.search(s):
            told[xxhash.xxh3_64_intdigest(masked(s))] = None
            lines += 1
    if (sure and (lines > 1 or 2 * size >= sum(map(len, parts)) or 2 * lines >= len(parts))) or wrongly_filled(text):
        return True, []
    return False, [h - (1 << 63) for h in told]


def residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id) of the documents that hold template residue, filler, an error-page message or a script notice.

    Segments are masked, normalised, hashed and grouped across sites, and those that recur over ``SITES`` sites and
    ``DOCUMENTS`` documents are classified by phrase rules. Equal hashes have equal classes, so the
    classes are told before the grouping, as a filter is pushed below an aggregate: only hashes of possible
    messages are shuffled. Slots, instructions, filler and pages that are messages for
    the most part decide by themselves. Slots and messages inside quotation marks or next to words that speak about them are not
    cases. Null, empty and blank texts and null ids give no row; a null source is a site of its own; equal
    ids give one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [examine(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.list_(pa.int64())), b.column(2)], ["doc_id", "sure", "told", "source"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    seen = stage(spread(rows, "doc_id").mapInArrow(run, "doc_id long, sure boolean, told array<long>, source string").where("sure or size(told) > 0"))
    told = seen.where("not sure").select("doc_id", "source", F.explode("told").alias("h"))
    # sites and documents that hold a message; distinct pairs first, so that no site or message gathers in one task
    wide = told.groupBy("h", "source").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("sites"), F.sum("n").alias("docs")).where((F.col("sites") >= SITES) & (F.col("docs") >= DOCUMENTS))
    by_message = told.join(wide.select("h"), "h", "left_semi").select("doc_id")
    return seen.where("sure").select("doc_id").unionByName(by_message).distinct()
