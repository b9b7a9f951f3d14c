"""Rule tables of the detectors: personal data, injections, and the ordered number rules that correct a model's entities.

Patterns are Java regular expressions, put together from named parts; none can match the empty string.  `group` says which part
of a match is the span: the whole match, the capture at its end ("suffix", a keyword comes before) or at its start ("prefix", an
honorific follows).
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    type: str
    pattern: str
    confidence: float
    group: str = "whole"
    validator: str | None = None
    #: What is quick to look for and without which the rule can't match: a character, HANGUL, DIGITS, or lower-case words that must all
    #: occur (a tuple among them: one of these), in the text in lower case.
    needs: str | tuple | None = None


#: type -> its Korean name in a placeholder
TYPE_LABEL = dict(
    pair.split(":") for pair in "ADDRESS:주소 BANK_ACCOUNT:계좌번호 CREDIT_CARD:카드번호 DATE_OF_BIRTH:생년월일 EMAIL:이메일 ID_NUMBER:신분증번호 ORGANIZATION:기관명 OTHER_PII:개인정보 PERSON_NAME:이름 PHONE:전화번호".split()
)
PII_TYPES = tuple(TYPE_LABEL)
#: injection type -> its name in the review panel
INJECTION_NAME = {
    "DATA_EXFILTRATION": "데이터 유출 시도",
    "HIDDEN_COMMAND": "숨겨진 명령",
    "INSTRUCTION_OVERRIDE": "명령 재정의",
    "JAILBREAK": "탈옥 시도",
    "OTHER_INJECTION": "인젝션",
    "ROLE_MANIPULATION": "역할 조작",
    "SYSTEM_PROMPT_LEAK": "시스템 프롬프트 유출",
}
INJECTION_TYPES = tuple(INJECTION_NAME)

#: Gates that many rules share; a detector looks for each once a text.
HANGUL, DIGITS = "[가-힣]", r"\d\d"

_GAP = r"[-\s]?"
_DOT = r"[-\s.]?"
_S = r"\s*"
_FOUR = r"\d{4}"
_SIX = r"\d{6}"
_RUN = r"\d{2,6}"
_HANGUL = "가-힣"


def _word(body: str) -> str:
    return rf"\b(?:{body})\b"


def _any(*words: str) -> str:
    return "(?:" + "|".join(words) + ")"


_SIX_SEVEN = r"\d{6}" + _GAP + "[%s]" + r"\d{6}"
_PROVINCE = _any("특별시", "광역시", "특별자치시", "특별자치도", "도")

#: Order decides between equals.
PII_RULES: tuple[Rule, ...] = (
    Rule("ID_NUMBER", _word(_SIX_SEVEN % "1-4"), 0.98, validator="rrn", needs=DIGITS),
    Rule("ID_NUMBER", _word(_SIX_SEVEN % "5-8"), 0.9, validator="rrn", needs=DIGITS),
    Rule("ID_NUMBER", _word(r"[DMORSdmors]\d{8}"), 0.6, needs=DIGITS),
    Rule("CREDIT_CARD", _word(_GAP.join([_FOUR] * 4)), 0.9, validator="luhn", needs=DIGITS),
    Rule("PHONE", _word(r"01[016-9]" + _DOT + r"\d{3,4}" + _DOT + _FOUR), 0.95, needs=DIGITS),
    Rule("PHONE", _word(r"0(?:[3-6][0-5]|2)" + _DOT + r"\d{3,4}" + _DOT + _FOUR), 0.8, needs=DIGITS),
    Rule("EMAIL", _word(r"[a-zA-Z\d._%+\-]+@[a-zA-Z\d.\-]+\.[a-zA-Z]{2,}"), 0.97, needs="@"),
    Rule("BANK_ACCOUNT", "(?i)" + _any("계좌번호", "계좌", "입금", "송금", "account") + _S + "(?:번호)?" + _S + "[:：]?" + _S + "(" + _RUN + r"[-\s]" + _RUN + _GAP + r"\d{0,6})", 0.85, "suffix", needs=DIGITS),
    Rule("DATE_OF_BIRTH", r"\b(?:19|20)\d\d" + _S + "[./년-]" + _S + r"\d{1,2}" + _S + "[./월-]" + _S + r"\d{1,2}" + _S + "일?", 0.55, needs=DIGITS),
    Rule("PERSON_NAME", _any("고객명", "담당자", "성명", "성함", "이름") + _S + "[:：]?" + _S + f"([{_HANGUL}]{{2,4}})(?![{_HANGUL}])", 0.8, "suffix", needs=HANGUL),
    Rule("PERSON_NAME", rf"\b([{_HANGUL}]{{2,4}})" + _S + _any("귀하", "드림", "님", "씨") + r"\b", 0.5, "prefix", needs=HANGUL),
    Rule("ADDRESS", f"[{_HANGUL}]+{_PROVINCE}\\s?[{_HANGUL}]+[시군구]\\s?[{_HANGUL}\\d]+[로길]\\s?\\d+(?:-\\d+)?(?:\\s?\\d+동)?(?:\\s?\\d+호)?", 0.75, needs=HANGUL),
    Rule("ORGANIZATION", _word(f"[{_HANGUL}a-zA-Z\\d]+" + _any("위원회", "협회", "재단", "연구원", "공단", "공사", "보험", "병원", "대학병원", "대학교", "카드", "증권", "은행", "전자", "㈜", "주식회사")), 0.5, needs=f"[㈜{_HANGUL}]"),
)


def _english(*steps: str) -> str:
    """Parts in a row, in any case."""
    return "(?i)" + "".join(steps)


_SP = r"\s+"
_MAYBE_ALL = r"(?:all\s+)?"
_OBJ = "[을를]?"

INJECTION_RULES: tuple[Rule, ...] = (
    Rule("INSTRUCTION_OVERRIDE", _any("앞", "위", "이전") + "의?" + _S + "(?:모든" + _S + ")?" + _any("내용", "대화", "명령", "지시", "지침") + "(?:사항)?들?[을를은는]?" + _S + "(?:모두" + _S + ")?" + _any("무시", "잊"), 0.95, needs=HANGUL),
    Rule("INSTRUCTION_OVERRIDE", _english("ignore", _SP, _MAYBE_ALL, r"(?:the\s+)?", _any("above", "earlier", "previous", "prior"), _SP, _any("context", "instructions", "messages", "prompts")), 0.95, needs=("ignore",)),
    Rule("INSTRUCTION_OVERRIDE", _english("forget", _SP, _any("all", "everything"), _SP, _any("above", "before", "previous")), 0.9, needs=("forget",)),
    Rule("INSTRUCTION_OVERRIDE", _english("disregard", _SP, _MAYBE_ALL, _any("previous", "prior", "the above"), _SP, _any("instructions", "rules")), 0.9, needs=("disregard",)),
    Rule("ROLE_MANIPULATION", "당신은" + _S + "이제" + _S + _any("제약" + _S + "없는", "제한" + _S + "없는", "보안" + _S + "필터가?" + _S + "없는"), 0.9, needs=HANGUL),
    Rule("ROLE_MANIPULATION", "너는" + _S + "이제" + _S + _any("제한" + _S + "없는", "보안" + _S + "필터가?" + _S + "없는"), 0.9, needs=HANGUL),
    Rule("ROLE_MANIPULATION", _english("you", _SP, "are", _SP, "now", _SP, _any("DAN", r"an?\s+unrestricted", r"a\s+system\s+with\s+no")), 0.9, needs=("you", "now")),
    Rule("ROLE_MANIPULATION", _english("act", _SP, "as", _SP, r"(?:an?\s+)?", _any("DAN", "jailbroken", "unrestricted")), 0.85, needs=("act",)),
    Rule("ROLE_MANIPULATION", _english("from", _SP, "now", _SP, "on,?", _SP, "you", _SP, "are"), 0.6, needs=("from", "now", "you")),
    Rule("SYSTEM_PROMPT_LEAK", "(?:지금까지" + _S + "받은" + _S + ")?(?:모든" + _S + ")?지시(?:사항)?" + _OBJ + _S + "(?:그대로" + _S + ")?" + _any("보여", "복사", "알려", "출력"), 0.85, needs=HANGUL),
    Rule("SYSTEM_PROMPT_LEAK", _any("초기" + _S + "설정", "시스템" + _S + "프롬프트") + _OBJ + _S + _any("보여", "알려", "출력"), 0.85, needs=HANGUL),
    Rule("SYSTEM_PROMPT_LEAK", _english(_any("print", "repeat", "reveal", "show"), _SP, r"(?:me\s+)?", "your", _SP, r"(?:system\s+)?", _any("instructions", "prompt")), 0.9, needs=("your",)),
    Rule("SYSTEM_PROMPT_LEAK", _english("what", _SP, "are", _SP, "your", _SP, r"(?:exact\s+)?", "instructions"), 0.85, needs=("what", "your", "instructions")),
    Rule("JAILBREAK", "(?i)DAN" + _S + "모드를?" + _S + _any("켜", "활성화"), 0.9, needs=HANGUL),
    Rule("JAILBREAK", _english(_any("dev", "developer"), _SP, "mode"), 0.7, needs=("dev", "mode")),
    Rule("JAILBREAK", _any("교육" + _S + "목적", "가상의?" + _S + "시나리오", "픽션") + _any("이니", "이므로", "으로") + "?.{0,20}" + _any("규제", "제한") + _S + "없이", 0.8, needs=HANGUL),
    Rule("JAILBREAK", _english("for", _SP, "a", _SP, _any("fictional", "hypothetical"), _SP, _any("scenario", "story")), 0.6, needs=(("fictional", "hypothetical"),)),
    Rule("HIDDEN_COMMAND", "(?is)<!--.*?" + _any("ignore", "instruction", "명령", "무시") + ".*?-->", 0.85, needs=("<!--",)),
    Rule("HIDDEN_COMMAND", "(?is)<font" + _SP + "color" + _S + "=" + _S + "[\"']?white[\"']?" + _S + ">.*?</font>", 0.8, needs=("<font",)),
    Rule("DATA_EXFILTRATION", _any("이" + _S + "대화", "위") + "의?" + _S + "(?:모든" + _S + ")?" + _any("개인정보", "내용") + _OBJ + _S + "(?:요약)?.{0,15}" + _any("나열", "보내", "알려", "전달", "전송", "출력"), 0.8, needs=HANGUL),
    Rule("DATA_EXFILTRATION", "(?:업로드된?" + _S + ")?" + _any("문서", "파일") + "의?" + _S + "(?:내용)?" + _OBJ + _S + "(?:모두" + _S + ")?나열", 0.75, needs=HANGUL),
    Rule("DATA_EXFILTRATION", _english("send", _SP, r"(?:a\s+)?", _any("summary", r"the\s+data", r"all\s+.{0,20}"), _SP, "to", _SP, "https?://"), 0.85, needs=("send", "http")),
    Rule("DATA_EXFILTRATION", _english("list", _SP, "all", _SP, _any("confidential", "data", r"personal\s+information")), 0.8, needs=("list", "all")),
)


def _alone(body: str) -> str:
    return rf"(?<!\d){body}(?!\d)"


_REGION_LONG = ("강원도", "경상남도", "경상북도", "전라남도", "전라북도", "충청남도", "충청북도", "서울특별시", *(x + "광역시" for x in ("광주", "대구", "대전", "부산", "울산", "인천")))
_REGION_SHORT = "강원 경기 경남 경북 광주 대구 대전 부산 서울 세종 울산 인천 전남 전북 제주 충남 충북".split()
_PLATE_KANA = "".join("가나다라마바사아자차카타파하 거너더러머버서어저처커터퍼허 고노도로모보소오조초코토포호 구누두루무부수우주".split())

_PLATE = r"\d{2,3}[" + _PLATE_KANA + r"]\s?" + _FOUR + r"(?!\d)"

#: In order of priority: an earlier rule's hit claims its place.  None matches a text without DIGITS.
NUMBER_RULES: tuple[tuple[str, str], ...] = (
    ("QT_DRIVER_NUMBER", _alone("-".join([r"\d{2}", r"\d{2}", r"\d{6}", r"\d{2}"]))),
    ("QT_CARD_NUMBER", _alone(r"[-\s]".join([_FOUR] * 4))),
    ("QT_RESIDENT_NUMBER", _alone("-[1-4]".join([_SIX] * 2))),
    ("QT_ALIEN_NUMBER", _alone("-[5-9]".join([_SIX] * 2))),
    ("QT_ALIEN_NUMBER", r"(?<![\dA-Z])[A-Z]" + _SIX * 2 + r"(?![\dA-Z])"),
    ("QT_MOBILE", _alone("01[016-9]" + _GAP + r"\d{3,4}" + _GAP + _FOUR)),
    ("QT_PHONE", _alone(r"0(?:2|[3-9]\d)-\d{3,4}-" + _FOUR)),
    ("QT_PLATE_NUMBER", "(?:" + _any(*_REGION_LONG, *_REGION_SHORT) + _SP + ")?" + _PLATE),
    ("QT_ACCOUNT_NUMBER", _alone(r"\d{3,4}-\d{3,4}-\d{3,6}")),
)

#: What a number rule needs besides DIGITS: the region that may come first is dear to look for at every letter.
NUMBER_NEEDS = {"QT_PLATE_NUMBER": _PLATE}

#: The model's 19 labels in terms of the 10 types.
LABEL_TYPE = {
    **dict.fromkeys(("QT_MOBILE", "QT_PHONE"), "PHONE"),
    **dict.fromkeys(("QT_ALIEN_NUMBER", "QT_DRIVER_NUMBER", "QT_PASSPORT_NUMBER", "QT_RESIDENT_NUMBER"), "ID_NUMBER"),
    **dict.fromkeys(("OG_DEPARTMENT", "OG_WORKPLACE"), "ORGANIZATION"),
    **dict.fromkeys(("CV_POSITION", "FD_MAJOR", "OGG_EDUCATION", "QT_AGE", "QT_PLATE_NUMBER"), "OTHER_PII"),
    "DT_BIRTH": "DATE_OF_BIRTH",
    "LC_ADDRESS": "ADDRESS",
    "PS_NAME": "PERSON_NAME",
    "QT_ACCOUNT_NUMBER": "BANK_ACCOUNT",
    "QT_CARD_NUMBER": "CREDIT_CARD",
    "TMI_EMAIL": "EMAIL",
}

UNKNOWN_LABEL = "개인정보"
INJECTION_LABEL = "인젝션"

#: The review panel's names, also of the model's labels; an unknown type is its own name.
PANEL_LABEL = {
    **TYPE_LABEL,
    **INJECTION_NAME,
    **dict(
        pair.split(":")
        for pair in "DT_BIRTH:생년월일 FD_MAJOR:전공 QT_AGE:나이 QT_PASSPORT_NUMBER:여권번호 TMI_EMAIL:이메일 QT_CARD_NUMBER:카드번호 QT_ACCOUNT_NUMBER:계좌번호 QT_PLATE_NUMBER:차량번호 QT_DRIVER_NUMBER:운전면허번호 QT_ALIEN_NUMBER:외국인등록번호 QT_RESIDENT_NUMBER:주민등록번호 QT_PHONE:전화번호 QT_MOBILE:휴대폰번호 OGG_EDUCATION:학력 CV_POSITION:직위 OG_DEPARTMENT:부서명 OG_WORKPLACE:근무지 LC_ADDRESS:주소 PS_NAME:이름".split()
    ),
}
