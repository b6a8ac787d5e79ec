"""Word lists, patterns and limits the rules work with.

Everything here is a default: each rule takes its lists as parameters. Strings that name one
particular office (hosts, menu names holding the office's name, greeting) are not stated here;
they come from :class:`SiteProfile`, whose defaults are placeholders.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------------------------
# Lists, patterns and limits that have to be exactly these for equal results.
# ---------------------------------------------------------------------------------------------

# every character Python's str.strip()/split() and \s treat as white space
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

NOISE_EXACT = [
    "열기", "닫기", "블로그", "인스타그램", "페이스북", "카카오", "트위터", "유튜브", "인쇄하기", "프린트",
    "공유", "목록", "검색", "로그인", "로그아웃", "사이트맵", "저작권", "개인정보처리방침", "이전글", "다음글",
]
NOISE_PREFIXES = [
    "이전글", "다음글", "만족도 조사", "콘텐츠 만족도", "저작권", "개인정보처리방침", "공유", "프린트", "인쇄하기",
    "SNS", "페이스북", "카카오", "인스타그램", "블로그", "유튜브", "열기", "닫기",
]
NOISE_BUNDLE_CORE = "블로그\n인스타그램\n페이스북\n카카오\n닫기"
NOISE_BUNDLE = rf"(열기\n)?{NOISE_BUNDLE_CORE}(\n인쇄하기)?"
WASTE_NOISE_EXACT = [
    "열기", "닫기", "블로그", "인스타그램", "페이스북", "카카오", "트위터", "유튜브", "공유", "인쇄하기", "프린트",
]
WASTE_JUNK = ["Home", ">", "열기", "닫기", "인쇄하기"]
PASSPORT_JUNK = ["210m", "[백상지"]

SECTION_HINTS = [
    "신청대상", "신청방법", "처리절차", "처리기간", "수수료", "구비서류", "제출서류", "유의사항", "문의처", "신고기한",
    "온라인 신청", "방문 신청", "담당부서", "전화번호",
]
# the office's own "home page" label is added from the profile, after the fourth entry
MENU_SIGNALS = [
    "비주얼 홍보 이미지", "이전 이미지", "다음 이미지", "퀵아이콘", "주메뉴", "만족도 조사", "개인정보처리방침",
    "저작권", "사이트맵", "공유", "프린트",
]
KEY_LINE_WORDS = [
    "배출", "처리방법", "수수료", "가격", "종량제", "봉투", "전용용기", "납부필증", "칩", "무상수거", "위탁처리",
    "배출신고", "처리증명", "과태료", "업체", "전화",
]

SHORTCUT_DENY = [
    "블로그", "인스타그램", "페이스북", "카카오", "트위터", "유튜브", "공유", "SNS", "맨처음페이지", "처음페이지",
    "이전페이지", "다음페이지", "10페이지 앞으로", "10페이지 뒤로", "맨끝페이지", "글쓰기", "수정", "삭제", "답글",
    "목록", "검색", "확인", "취소", "로그인", "로그아웃",
]
SHORTCUT_ALLOW = [
    "계약정보공개", "재정정보공개", "입찰정보", "전자민원창구", "정부24", "민원접수", "신청", "조회", "예약", "발급",
    "바로가기",
]
SHORTCUT_GENERIC = ["바로가기", "자세히보기", "자세히 보기"]
SHORTCUT_LABELS = [
    "바로가기", "신청하기", "예약하기", "조회하기", "다운로드", "홈페이지", "사이트", "민원24", "정부24",
]
MENU_SHORTCUTS = ["계약정보공개", "재정정보공개"]
HOST_LABELS = [("passport.go.kr", "여권안내 홈페이지"), ("gov.kr", "정부24"), ("korea.kr", "대한민국 정책브리핑")]

NON_PAGE_SCHEMES = ["javascript:", "mailto:", "tel:"]
ALLOWED_PATHS = [
    "/portal/contents.do", "/portal/bbs/list.do", "/portal/bbs/view.do", "/portal/civil/list.do",
    "/portal/civil/view.do",
]
DENY_URL_WORDS = [
    "javascript:", "mailto:", "tel:", "login", "logout", "sitemap", "popup", "calendar", "youtube", "blog",
    "facebook", "instagram", "twitter", "kakao", "share", "print", "viewer", "filedown", "download",
]
PAGE_TYPES = [
    ("/portal/bbs/list.do", "bbs_list"), ("/portal/bbs/view.do", "bbs_view"),
    ("/portal/civil/list.do", "civil_list"), ("/portal/civil/view.do", "civil_view"),
    ("/portal/contents.do", "contents"),
]
SAVED_PAGE_TYPES = ["contents", "bbs_view", "civil_view"]
EXCLUDED_MENU_PREFIXES = ["0407", "0408", "0503", "0505", "0507", "0508"]
FORCED_MENU_IDS = ["0103010000"]

SENTENCE_ENDINGS = [
    "입니다", "합니다", "됩니다", "있습니다", "없습니다", "바랍니다", "하세요", "하십시오", "가능합니다",
]
HEADING_STOP_WORDS = [
    "왼쪽 메뉴", "오른쪽 메뉴", "이용해주시면", "발급하실 수", "각종", "위하여", "때문에", "경우",
]
WASTE_HEADING_STARTS = ["※", "-", "·", "ㆍ"]
WASTE_HEADING_EXACT = ["배출일시", "배출방법", "다량배출사업장이란?", "대형폐가전 : 무상수거", "소형폐가전 : 무상수거"]
WASTE_HEADING_VALUES = [
    "아래", "매주", "상시", "인터넷", "콜센터", "요일", "배출", "품목", "수거함", "전화", "문의", "신청", "방법",
]
WASTE_HEADING_ENDINGS = ["안내", "방법", "절차", "대상", "기준", "발급", "신고", "처리", "수거"]
LIST_HEADING_WORDS = ["경우", "배출", "신청", "처리", "사용", "문의", "수거", "가능", "불가"]
LIST_HEADING_ENDINGS = ["안내", "사항", "대상", "방법", "절차", "기준", "요령", "업체"]
REAL_HEADING_BAD_WORDS = [
    " 왼쪽 ", " 오른쪽 ", " 또는 ", " 그리고 ", " 하지만 ", " 위하여 ", " 때문에 ", " 따라서 ", " 경우 ",
]
BAD_TITLES = ["서브 메뉴", "메뉴", "주메뉴", "사이트맵", "검색", "공유", "프린트"]
BAD_HEADINGS = ["Home", "분야별정보", "환경/청소", "폐기물", "분류", "분 류", "품명", "품 명"]
TABLE_HEADER_WORDS = ["분류", "분 류", "품명", "품 명"]
SKIPPED_PAGE_STRINGS = ["Home", "전자민원", "종합민원안내"]
BROAD_MENUS = ["분야별정보", "환경/청소"]
COUNTED_UNITS = ["원", "명", "건", "회", "개", "일", "개월", "년", "층", "시", "분", "번", "호", "대"]

FORM_LABELS = [
    "민원분야", "담당부서", "담당자 전화번호", "처리기간", "신청서 및 구비서류", "제출처", "수수료 및 기타비용", "유의사항",
    "행정기관의 심사기준", "업무처리 흐름도", "이의신청", "기타",
]
# column of the raw form document that holds each label's text
FORM_COLUMNS = [
    "category", "department", "phone", "processing_period", "required_documents", "submission_place", "fee", "notes",
    "review_criteria", "workflow", "appeal", "etc",
]
FORM_STOPS = ["첨부파일", "목록", "만족도조사", "Quick Menu"]
FORM_TITLE_NOISE = [
    "Home", "전자민원", "종합민원안내", "열기", "블로그", "인스타그램", "페이스북", "카카오", "닫기", "인쇄하기", "내용보기",
]
FORM_TARGET_WORDS = [
    "전입", "전출", "이사", "주민등록", "등본", "초본", "인감증명", "본인서명사실확인", "본인", "세대", "복지", "복지지원",
    "지원금", "수급자", "장애인", "출산", "보육", "아동수당", "어르신", "노인",
]
BID_STARTS = [
    "1. 공고대상", "1. 입찰에 부치는 사항", "1. 공고기간", "1. 견적에 부치는 사항", "가. 입찰건명",
]
BID_STOPS = ["목록", "만족도조사", "Quick Menu"]
BID_BODY_MARKERS = ["1. 공사개요", "1. 용역개요", "1. 공고대상"]

DEPARTMENT_LABELS = [r"담당부서", r"콘텐츠\s*관리부서", r"작성자"]
DATE_LABELS = ["최근업데이트", "최종수정일", "등록일", "작성일", "게시일"]
VIEW_LABELS = ["조회수", "조회"]

ATTACHMENT_PAGE_WORDS = [
    "민원", "civil", "passport", "서식", "여권", "필요", "준비", "서류", "신청서", "서식", "양식", "발급",
]
MARKDOWN_LINK = r"\[((?:\[[^\]]+\]|[^\]])+)\]\((https?://[^\)]+|/[^\)]+)\)"
LOCAL_FILES = ["여권발급신청서", "법정대리인동의서", "여권분실신고서", "긴급여권발급신청사유서"]
LOCAL_FILE_FOLDER = "/download/passport_pdfs/"

RANGE_UNITS = ["일", "주", "개월", "시간", "분", "년", "월", "개", "명", "건", "회", "원", "층", "시"]

FILE_EXTENSIONS = "hwp|hwpx|pdf|doc|docx|xls|xlsx|zip"

NOISE_SELECTORS = [
    "script", "style", "noscript", "iframe", "svg", "header", "footer", "nav", "aside", "#header", "#footer", "#gnb",
    "#lnb", "#snb", ".header", ".footer", ".gnb", ".lnb", ".snb", ".skip", ".breadcrumbs", ".location", ".quick",
    ".quickMenu", "#quickMenu", ".snsArea", ".shareArea", ".printArea", ".satisfaction", ".survey", ".comment",
    ".reply", ".prevNext", ".boardBtn", ".btnArea", ".pagination", ".searchArea", ".banner", ".popupZone", ".viewer",
    ".copy", ".copyright", ".familySite", ".siteLink", ".util", ".topBanner",
]
WASTE_NOISE_SELECTORS = [
    "script", "style", "noscript", "iframe", "svg", "header", "footer", "nav", "aside", "#header", "#footer", "#gnb",
    "#lnb", "#snb", ".header", ".footer", ".gnb", ".lnb", ".snb", ".skip", ".breadcrumbs", ".location", ".quick",
    ".snsArea", ".shareArea", ".printArea", ".satisfaction", ".survey", ".comment", ".reply", ".prevNext",
    ".boardBtn", ".btnArea", ".pagination", ".searchArea", ".tabMenu", ".banner", ".popupZone", ".viewer", ".copy",
    ".copyright", ".familySite", ".siteLink", ".util", ".topBanner",
]
FORM_NOISE_SELECTORS = [
    "script", "style", "noscript", "iframe", "svg", "header", "footer", "nav", "aside", "#header", "#footer", "#gnb",
    "#lnb", "#snb", ".header", ".footer", ".gnb", ".lnb", ".snb", ".quickMenu", ".snsArea", ".shareArea",
    ".printArea",
]
BID_NOISE_SELECTORS = ["script", "style", "noscript", "iframe", "svg"]
CONTENT_SELECTORS = [
    "#contents", "#content", ".contents", ".content", ".cntArea", ".sub_content", ".contArea", ".article",
    ".board_view", ".view_cont", ".conBox", "main", "article",
]
WASTE_CONTENT_SELECTORS = ["#conts", "#contents", "#content", ".contents", ".content"]
FORM_CONTENT_SELECTORS = [
    "#contents", "#content", ".contents", ".content", ".cntArea", ".sub_content", ".contArea", "main", "article",
    "body",
]
TITLE_SELECTORS = [
    "h1", "h2", "h3", ".contTitle", ".pageTitle", ".subject", ".conTit", ".view_tit", ".board_tit", ".bbsTitle",
    ".titArea h3", ".contents h3",
]

RRF_K = 60
TOP_K = 5
DISTANCE_LIMIT = 0.7
THRESHOLD_TOP_K = 3
MAX_PAGES = 100
MAX_BOARD_PAGES = 10
CURRENT_YEAR = 2026
YEAR_MENU_SPAN = 5
FORM_MIN_YEAR = 2021
RECENT_AS_OF = "2026-05-13"
RECENT_DAYS = 365


@dataclass(frozen=True)
class SiteProfile:
    """Everything that names one particular office. Defaults are placeholders to be replaced."""

    name: str = "우리"
    english_name: str = "Our District Office"
    assistant_greeting: str = "안녕하세요! 민원 상담을 도와드릴게요."
    hosts: tuple[str, ...] = ("www.portal.example.kr", "m.portal.example.kr")
    base_url: str = "https://www.portal.example.kr"
    source: str = "portal.example.kr"
    notice_base_url: str = "https://notice.portal.example.kr"
    notice_action_url: str = "https://notice.portal.example.kr/emwp/gov/mogaha/ntis/web/ofr/action/OfrAction.do"
    notice_list_url: str = (
        "https://notice.portal.example.kr/emwp/jsp/ofr/OfrNotAncmtLSub.jsp?not_ancmt_se_code=02"
    )
    notice_source: str = "notice.portal.example.kr"
    backend_url: str = "http://localhost:8000"
    passport_source: str = "passport.go.kr"
    passport_url: str = "https://www.passport.go.kr/home/kor/applicationForm/index.do?menuPos=42"
    forced_menu_ids: tuple[str, ...] = tuple(FORCED_MENU_IDS)
    excluded_menu_prefixes: tuple[str, ...] = tuple(EXCLUDED_MENU_PREFIXES)
    extra_link_hosts: tuple[str, ...] = field(default=())

    @property
    def top_menus(self) -> dict[str, str]:
        return {
            "01": "전자민원", "02": "구민참여", "03": "정보공개", "04": "분야별정보",
            "05": f"{self.name}복지", "06": f"{self.name}소개",
        }

    @property
    def menu_signals(self) -> list[str]:
        return [*MENU_SIGNALS[:4], f"{self.name}구 홈페이지", *MENU_SIGNALS[4:]]

    @property
    def noise_headings(self) -> list[str]:
        return [
            "Home", "전자민원", "정보공개", "구민참여", "분야별정보", f"{self.name}소개", f"{self.name}정보", "종합민원안내",
        ]

    @property
    def waste_parent_url(self) -> str:
        return f"{self.base_url}/portal/contents.do?mId=0405050000"

    @property
    def notice_start_url(self) -> str:
        return f"{self.base_url}/portal/contents.do?mId=0301040000"

    @property
    def file_down_url(self) -> str:
        return f"{self.base_url}/cmm/fms/FileDown.do"

    @property
    def form_list_url(self) -> str:
        return f"{self.base_url}/portal/civil/list.do?mId=0103080100"

    @property
    def seeds(self) -> list[tuple[str, list[str]]]:
        def url(mid):
            return f"{self.base_url}/portal/contents.do?mId={mid}"

        return [
            (url("0100000000"), ["전자민원"]),
            (url("0203000000"), ["구민참여", "신고센터"]),
            (url("0301000000"), ["정보공개", f"{self.name}알림"]),
            (url("0302000000"), ["정보공개", "행정정보공개"]),
            (url("0605000000"), [f"{self.name}소개", "청사안내"]),
            (url("0400000000"), ["분야별정보"]),
            (url("0500000000"), [f"{self.name}복지"]),
        ]


DEFAULT_PROFILE = SiteProfile()
