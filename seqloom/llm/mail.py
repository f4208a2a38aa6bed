"""The own text of a mail: its new body, decoded, without what was quoted or is boilerplate."""

from __future__ import annotations

import base64
import html
import re
import unicodedata

HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
TYPE = re.compile(r"^content-type:[ \t]*([^;\s]*)((?:[^\n]|\n[ \t])*)", re.I | re.M)
BOUNDARY = re.compile(r'boundary[ \t]*=[ \t]*(?:"([^"\n]*)"|([^\s;]+))', re.I)
CHARSET = re.compile(r'charset[ \t]*=[ \t]*"?([\w.:-]+)', re.I)
ENCODING = re.compile(r"^content-transfer-encoding:[ \t]*([\w-]+)", re.I | re.M)
ATTACHED = re.compile(r"^content-disposition:[ \t]*attachment|^content-type:[^\n]*(?:\n[ \t][^\n]*)*?\bname[ \t]*=", re.I | re.M)
TAG = re.compile(r"<(?:style|script|head|blockquote)\b.*?</(?:style|script|head|blockquote)\s*>|<br\b[^>]*>|</?(?:p|div|tr|li|ul|h\d)\b[^>]*>|<[^>]*>", re.I | re.S)

# fixed values: how mail programs and people mark quoted mail, closings and disclaimers in three languages
CUT = re.compile(r"[ \t]*(?:-{2,}[ \t]*(?:original message|ursprüngliche nachricht|mensaje original|forwarded message|weitergeleitete nachricht|mensaje reenviado)\b|begin forwarded message)", re.I)
RULE = re.compile(r"[ \t]*_{8,}[ \t]*$")
FROM = re.compile(r"[ \t]*(?:from|von|de):", re.I)
SAID = re.compile(r"\b(?:wrote|schrieb|escribió)\b")
SOON = re.compile(r"\s*(?:on|am|el)\b.*\d", re.I)
DATED = re.compile(r"\d|@")
COLON = re.compile(r":\s*$")
BULLET = re.compile(r"[*•-] ")
QUOTED = re.compile(r"[ \t]*[>|]")
CLOSING = re.compile(
    r"(?:cheers|thanks|thank you|many thanks|best|best wishes|all the best|(?:kind |best |warm )?regards|yours|sincerely|mfg|viele gr(?:ü|ue)(?:ß|ss)e|(?:mit )?(?:schönen?|freundlichen|besten|lieben) gr(?:ü|u)(?:ß|ss)e?n?|liebe gr(?:ü|ue)(?:ß|ss)e|gracias|saludos|un saludo|(?:un )?abrazo|atentamente)[ \t]*[,.!]?",
    re.I,
)
DISCLAIMER = re.compile(
    r"confidential\b|vertraulich|confidencial|meant for the person|intended (?:only )?for|views given here|views expressed|before you print|wirklich gedruckt|antes de imprimir|no constituye contrato|kein vertrag", re.I
)
GREETING = re.compile(r"(?:(?:hi|hello|dear|hey|good morning|good afternoon|guten|liebe[rs]?|hallo|hola|estimad\w+|buenos|buenas|querid\w+)\b[^.?!\n]{0,40}[,:!]?|[\w'-]+(?: [\w'-]+)? [-–])", re.I)
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
MISREAD = re.compile("[ÃÂâ][\x80-¿Œ-™]")


def quoted_printable(text: str) -> bytes:
    """Bytes of quoted-printable text; what is no valid escape stays as it is."""
    text = re.sub(r"=[ \t]*\n", "", text)
    data = text.encode("utf-8", "surrogatepass")
    return re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), data)


def unbase64(text: str) -> bytes:
    """Bytes of base64 text, as far as it goes."""
    clean = re.sub(r"[^A-Za-z0-9+/]", "", text.split("\n--")[0])
    clean = clean[: len(clean) - (len(clean) % 4 == 1)]
    try:
        return base64.b64decode(clean + "=" * (-len(clean) % 4))
    except ValueError:
        return b""


def _text(data: bytes, charset: str) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    if len(data) > 3:
        try:  # cut inside a character
            return data[:-3].decode("utf-8") + data[-3:].decode("utf-8", "ignore")
        except UnicodeDecodeError:
            pass
    try:
        return data.decode("cp1252" if charset.lower() in ("", "utf-8", "us-ascii", "iso-8859-1", "latin1") else charset, "replace")
    except LookupError:
        return data.decode("cp1252", "replace")


def _repair(text: str) -> str:
    """UTF-8 that was once read as a single-byte code."""
    if not MISREAD.search(text):
        return text

    def piece(m: re.Match) -> str:
        for code in ("cp1252", "latin-1"):
            try:
                return m[0].encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        return m[0]

    return re.sub("[À-ÿ][\x80-¿Œ-™]{1,3}", piece, text)


def _plain(source: str) -> str:
    return html.unescape(TAG.sub(lambda m: "\n\n" if re.match(r"</?(?:p|br|div|tr|li|ul|h\d)", m[0], re.I) else " ", source))


def _split(text: str) -> tuple[str, str]:
    """Header and body; a text that doesn't begin with a header line is all body."""
    text = text.lstrip("\n")
    if not HEADER.match(text):
        return "", text
    head, _, body = text.partition("\n\n")
    return head, body


def _part(head: str, body: str, found: list[tuple[str, str]], depth: int = 0) -> None:
    m = TYPE.search(head)
    kind, rest = (m[1].lower(), m[2]) if m else ("text/plain", "")
    if kind.startswith("multipart/") and depth < 8:
        b = BOUNDARY.search(rest)
        mark = b and (b[1] if b[1] is not None else b[2])
        if mark:
            for piece in re.split(r"(?:^|\n)--" + re.escape(mark) + r"(?:--)?[ \t]*(?:\n|$)", body)[1:]:
                if piece.strip():
                    inner, sep, content = piece.partition("\n\n")
                    if piece.startswith("\n"):
                        inner, content = "", piece
                    _part(inner, content, found, depth + 1)
            if found or depth:
                return
        kind = "text/plain"
    if ATTACHED.search(head) or not kind.startswith("text/"):
        return
    e = ENCODING.search(head)
    coding, charset = e[1].lower() if e else "", (c[1] if (c := CHARSET.search(rest)) else "")
    if coding == "quoted-printable":
        body = _text(quoted_printable(body), charset)
    elif coding == "base64":
        body = _text(unbase64(body), charset)
    found.append((kind, body.replace("\r\n", "\n").replace("\r", "\n")))


def body_of(text: str) -> str:
    """The decoded body: all plain parts, or where there is none the HTML parts as text."""
    head, body = _split(text.replace("\r\n", "\n").replace("\r", "\n"))
    found: list[tuple[str, str]] = []
    _part(head, body, found)
    plain = [b for k, b in found if k != "text/html"]
    out = "\n\n".join(plain) if any(p.strip() for p in plain) else "\n\n".join(_plain(b) for _, b in found)
    out = _repair(out)
    return out if out.isascii() else INVISIBLE.sub("", unicodedata.normalize("NFKC", out))


def _intro(lines: list[str], k: int) -> int:
    """How many lines from k on say who wrote what follows; 0 if they don't."""
    line = lines[k]
    if not SAID.search(line) and not (SOON.match(line) and any(SAID.search(x) for x in lines[k + 1 : k + 3])):
        return 0
    for n in (1, 2, 3):
        if k + n <= len(lines) and COLON.search(lines[k + n - 1]):
            said = " ".join(lines[k : k + n])
            return n if SAID.search(said) and DATED.search(said) else 0
    return 0


def _closes(line: str) -> bool:
    bare = line.strip()
    return bare in ("--", "---", "—") or len(bare) < 40 and bool(CLOSING.fullmatch(bare))


def _answer(lines: list[str]) -> list[str]:
    """What stands after an unmarked quotation: the last letter that follows a closing and its signature."""
    closings = [i for i, x in enumerate(lines) if _closes(x)]
    for n in range(len(closings) - 1, -1, -1):
        k = closings[n] + 1
        end = closings[n + 1] if n + 1 < len(closings) else len(lines)
        while k < end and lines[k].strip():
            k += 1
        while k < end and (not lines[k].strip() or DISCLAIMER.search(lines[k])):
            if lines[k].strip():
                while k < end and lines[k].strip():
                    k += 1
            else:
                k += 1
        if k < end:
            return lines[k:]
    return []


def _unquoted(lines: list[str], depth: int = 0) -> list[str]:
    kept: list[str] = []
    own = lambda: any(x.strip() and not GREETING.fullmatch(x.strip()) for x in kept)
    k = 0
    while k < len(lines):
        line = lines[k]
        if QUOTED.match(line):
            k += 1
            continue
        if CUT.match(line) or (RULE.match(line) and k + 1 < len(lines) and FROM.match(lines[k + 1])):
            return kept if own() or depth > 3 else _unquoted(_answer(lines[k + 1 :]), depth + 1)
        if width := _intro(lines, k):
            if not QUOTED.match(next((x for x in lines[k + width :] if x.strip()), "")):
                return kept if own() or depth > 3 else _unquoted(_answer(lines[k + width :]), depth + 1)
            k += width
            continue
        kept.append(line)
        k += 1
    return kept


def own_paragraphs(text: str) -> list[str]:
    """Paragraphs of the sender's own words, lines joined: without quotations marked or unmarked, before or after
    them, signature, disclaimer and greeting."""
    out, now = [], []
    for line in [*_unquoted(body_of(text).split("\n")), ""]:
        bare = line.strip()
        if bare and _closes(bare):
            break
        if not bare or BULLET.match(bare):
            if now:
                out.append(" ".join(now))
            now, bare = [], bare[2:]
        if bare:
            now.append(bare)
    if now:
        out.append(" ".join(now))
    return [p for p in out if not DISCLAIMER.search(p) and not GREETING.fullmatch(p)]


# a sentence ends with a mark, a smiley, or an emoji and the few small words that belong to it, before what begins like one
SENTENCE = re.compile(r"(?<=[.?!…])[\"'»”)]*\s+(?=[\"'«“(¿¡]*[^\W\d_a-zß-öø-ÿ]|[¿¡\"'«“(]|[^\w\s])|(?<=:-\))\s+|(?<=\x00)\s+")
REMARK = re.compile(r"([\u2600-\u27bf\U0001f300-\U0001faff]\ufe0f?(?: [a-zß-öø-ÿ']+){0,3})(?= [\"'«“(¿¡]*[^\W\d_a-zß-öø-ÿ])")


def own_sentences(text: str) -> list[str]:
    marked = (p if p.isascii() else REMARK.sub("\\1\x00", p) for p in own_paragraphs(text))
    return [s for p in marked for x in SENTENCE.split(p) if (s := x.replace("\x00", "")).strip()]
