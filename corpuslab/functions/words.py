"""Word tables the text rules use."""

# English term -> Korean term, applied to whole tokens.
TRANSLATIONS = {
    "ENERGY": "에너지", "MODEL": "모델", "CANCER": "암", "DISEASE": "질환", "ANALYSIS": "분석", "SYSTEM": "시스템",
    "THERAPY": "치료법", "STEM": "줄기", "PROTEIN": "단백질", "BRAIN": "뇌", "NETWORK": "네트워크", "LEARNING": "학습",
    "SMART": "스마트", "COMPUTER": "컴퓨터", "MAGNETIC": "마그네틱", "SIGNAL": "시그널", "DATA": "데이터", "SENSOR": "센서",
    "DESIGN": "디자인", "MEMORY": "메모리", "MODELING": "모델링", "VIDEO": "비디오", "OPTIMIZATION": "최적화",
    "SOCIAL": "소셜", "VIRTUAL": "가상", "INFORMATION": "정보", "MULTIMEDIA": "멀티미디어", "ALGORITHM": "알고리즘",
    "WEB": "웹", "LOCATION": "위치", "RECOGNITION": "인지", "CONTROL": "제어", "SECURITY": "보안", "WEARABLE": "착용형",
    "MINING": "마이닝", "CONTEXT": "컨텍스트", "INTELLIGENT": "지능", "SIMULATION": "시물레이션", "WIRELESS": "무선", "ARCHITECTURE": "아키텍처",
    "INTERFACE": "인터페이스", "DISTRIBUTED": "분산", "DISTRIBUTION": "분산", "CLOUD": "클라우드", "CELL": "세", "CELLS": "세포",
    "BIO": "바이오", "DATABASE": "데이터베이스", "PROCESSING": "프로세싱", "CHANGE": "변화", "CLIMATE": "기후", "EVOLUTION": "진화", "STUDY": "연구",
    "STRUCTURE": "구조", "CARBON": "탄소", "AIR": "에어", "GENE": "유전자", "CULTURE": "문화", "MACHINE": "기계", "COMPUTING": "컴퓨팅",
    "DETECTION": "탐지", "INTERNET": "인터넷", "PARALLEL": "병렬", "MOBILE": "모바일", "SOFTWARE": "소프트웨어", "DEVICE": "기기", "NANO": "나노",
    "GAS": "가스", "PROGRAM": "프로그램", "DEVELOPMENT": "개발", "EDUCATION": "교육", "QUALITY": "품질", "TEST": "테스트", "BACTERIA": "박테리아",
    "GENOME": "유전체", "SEQUENCING": "시퀀싱", "DOMAIN": "도메인", "GENETICS": "유전학", "TUMOR": "종양", "PATTERN": "패턴",
    "CHANNEL": "채널", "RESEARCH": "연구", "VIRUS": "바이러스", "MEASUREMENT": "측정",
}

# Stop words of the project corpus.
STOP_WORDS = [
    "OF", "AND", "ET", "AL", "IN", "AS", "IS", "FROM", "OR", "UP", "THE", "FOR", "BASED",
    "CAN", "ARE", "USING", "THIS", "THAT", "근간한", "대한", "활용", "관련", "가능", "연구", "개발", "통한",
    "제시", "제공", "이용", "적용", "다양", "0", "의한", "ET", "중요", "TO", "BE", "BY", "WITH", "WILL", "ON", "부터", "및", "기존", "주요", "대부분",
    "위한", "이용한", "개발", "관한", "미치는", "기반의", "활용한", "규명", "새로운", "기반", "유래", "기술", "시스템", "따른", "II", "때", "여러", "에서",
    "방안", "기법", "최근", "경우", "위해", "첫째", "둘째", "셋째", "때문", "모두", "RELATED", "아니", "이미", "REAL", "에서", "분야", "진행", "수행",
    "현재", "국내", "세계", "단계", "사용", "기대", "과제", "결과", "방법", "필요", "과학", "기술", "수준", "학문", "산업", "다른", "가장", "하나",
    "통하", "가지", "연구자", "대해", "아직", "대상", "이들", "사이", "기여", "효과", "발전", "국가", "구축", "핵심", "목표", "시장", "확보", "원천",
    "경제", "경쟁력", "특허", "향상", "측면", "고려", "구축", "학적", "하지", "실제", "바탕", "예정", "보고", "생각", "인해", "확인",
    "분석", "도출", "종합", "파악", "세", "우리", "제안", "논문", "학술", "시도", "접근", "방향", "계획", "형태", "증가", "성과",
]

# Lemmas dropped from award abstracts.
AWARD_STOP_WORDS = [
    "research", "researcher", "participant", "community", "university", "provide", "use", "student", "problem", "new", "workshop", "develop",
    "hold", "international", "science", "engineering", "conference", "area", "engineering", "group", "study", "analysis", "program", "project",
    "work", "system", "undergraduate", "technology", "education", "support", "propose", "design", "result", "effect", "year", "proposal",
    "include", "development", "understand", "understanding", "important",
]

# Korean counters that follow a number.
COUNTERS = ["차", "개", "년", "시", "세", "점", "번", "명", "위", "년", "차년", "회", "주", "차원", "곳", "만명", "개월", "분", "차년도", "단계", "가지", "년차"]

# Area names that carry no information.
STOP_AREAS = ["0", "6T", "기타(위의 미래유망신기술(6T) 103개 세분류에 속하지 않는 기타 연구)"]

# Fixed value: the convergence-research area used as the binary class.
CONVERGENCE_AREA = "ICT·융합연구"
