"""Values that results depend on.

Fixed values: column layouts, word lists, labels, class edges and formats below must stay exactly
as written, because reports are compared on them. Anything that can be derived is derived.
"""

from __future__ import annotations

# --- Calendar ------------------------------------------------------------------------------
MONTHS = (
    "Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho",
    "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro",
)
MONTHS_SHORT = (
    "Jan", "Fev", "Mar", "Abr", "Mai", "Jun",
    "Jul", "Ago", "Set", "Out", "Nov", "Dez",
)
CALENDAR_FIRST_YEAR = 2018
SEMESTER_SUFFIX = "º sim"
QUARTER_SUFFIX = "º tri"
BIMESTER_SUFFIX = "º bim"
GENERAL_MIN_YEAR = 2017
REFERENCE_MONTHS = ("Outubro", "Novembro", "Dezembro")
ATTENDANT_REPORT_MONTHS = ("Novembro", "Dezembro")

# --- Date patterns (one or two digits for day, month and hour) -------------------------------
TIMESTAMP_PATTERN = "d/M/yyyy H:mm:ss"
DATE_PATTERN = "d/M/yyyy"
DISPLAY_TIMESTAMP_PATTERN = "dd/MM/yyyy HH:mm:ss"
PERIOD_KEY_PATTERN = "yyyy/MM"

# --- White space -----------------------------------------------------------------------------
ASCII_BLANKS = " \t\n\x0b\x0c\r"
UNICODE_BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- Portuguese letters and their unaccented forms ---------------------------------------------
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
UNACCENTED = "aaaaaeeeeiiiiooooouuuucn"

# --- Answers -----------------------------------------------------------------------------------
RATING_WORDS = ("ruim", "regular", "bom", "otimo")  # ordinal 1..4
RATING_LABELS = ("Ruim", "Regular", "Bom", "Otimo")
LIKERT_ANSWERS = ("Péssimo", "Ruim", "Regular", "Bom", "Ótimo")  # score 0.2 .. 1.0
RECEPTION_ANSWERS = ("Não se aplica", "Péssimo", "Ruim", "Regular", "Bom", "Ótimo")
USUAL_ANSWERS = {  # as the form offers them, with the folded text of each
    "Ruim": "ruim", "Regular": "regular", "Bom": "bom", "Ótimo": "otimo",
    "Péssimo": "pessimo", "Não se aplica": "nao se aplica", "": "",
}
GOOD_ANSWERS = ("Bom", "Ótimo")

# --- Question blocks of the general form, in order ---------------------------------------------
BLOCK_SIZES = {"a": 3, "b": 4, "c": 3, "d": 3, "e": 2, "f": 3, "g": 3, "h": 7}
MEASURE_LABELS = (
    "Recepção", "Médico", "Enfermagem", "Serviço Social", "Pscicologia", "Nutrição",
    "Reabilitação", "Infraestrutura", "Ambulatório", "Geral",
)
MEASURE_TARGET = 80.0
# The thirteen composite scores S01..S13 and the question behind each; the ninth is constant 0.
COMPOSITE_QUESTIONS = (
    "a_1", "b_1", "c_1", "d_1", "e_1", "f_1", "g_1", "g_2", None, "h_1", "h_2", "h_3", "h_4",
)
SAFETY_QUESTION = "h_2"

# --- NPS ---------------------------------------------------------------------------------------
DETRACTOR_MAX = 6
PROMOTER_MIN = 9
NPS_CLASSES_V1 = ("Detrator", "Neutro", "Promoter")
NPS_CLASSES_V2 = ("detrator", "neutro", "promotor")
NPS_FLAGS = {"promotor": "🟢", "neutro": "🔵", "detrator": "🔴"}
ZONE_LABELS_V1 = (
    "ZONA CRÍTICA", "ZONA DE APERFEIÇOAMENTO", "ZONA DE QUALIDADE", "ZONA DE EXCELENCIA",
)
ZONE_LABELS_V2 = ("Crítica", "Aperfeiçoamento", "Qualidade", "Excelência")
ZONE_EDGES = (0, 50, 75)
ORIGIN_GENERAL = "GERAL"
ORIGIN_AMBULATORY = "AMBULATORIO"
ID_PREFIX_GENERAL = "G."
ID_PREFIX_AMBULATORY = "A."
SATISFACTION_BANDS = ("BOM/OTIMO", "NULO", "BAIXO")

# --- Sectors, comments, manifestations -----------------------------------------------------------
SECTOR_NOT_INFORMED = "Não informado"
SECTOR_AMBULATORY = "Ambulatório"
COMMENT_KINDS = ("elogios", "sugestoes", "reclamacoes")
AMBULATORY_CONSENT = "Sim"
MANIFESTATION_TYPES = ("elogio", "sugestao", "reclamacao", "preferiu nao informar")
MISSING_TEXT = "-"
INDICATOR_LABELS = (
    "QUANTIDADE DE AVALIAÇÕES ENTRE BOM E ÓTIMO NA PESQUISA DE SATISFAÇÃO",
    "TOTAL DE PESSOAS PESQUISADAS NA PESQUISA DE SATISFAÇÃO",
)
DISPLAY_HEADINGS = {
    "preferiu_nao_informar": "não informou",
    "elogio": "elogios",
    "sugestao": "sugestões",
    "reclamacao": "reclamações",
    "proporcao": "% proporção",
}

# --- Text that stands for a missing value, by reader -----------------------------------------------
NULL_TOKENS = {
    "blank": ("",),
    "na_only": ("NA",),
    "wide": (
        "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
        "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
    ),
}

# --- Positional column layouts -----------------------------------------------------------------
QUESTIONS = tuple(f"{b}_{i}" for b, n in BLOCK_SIZES.items() for i in range(1, n + 1))
AMBULATORY_QUESTIONS = ("recepcao", "medico")
_GENERAL_BASE = (
    "data", "nome", "data_internacao", "data_alta", "contato", "autorizo", "setor",
    *QUESTIONS,
    "elogios", "sugestoes", "reclamacoes", "mes_consolidacao", "id", "ano_consolidacao",
)
_AMBULATORY_BASE = (
    "data", "nome", "contato", "recepcao", "medico", "elogios", "reclamacoes", "sugestoes",
    "id", "mes_consolidacao", "atendente", "ano_consolidacao",
)
LAYOUTS = {
    "general46": (
        *_GENERAL_BASE,
        "pesquisa_ativa", "equipe_pesquisa", "nps", "quando_queixa", "periodo_queixa",
    ),
    "general41": _GENERAL_BASE,
    "ambulatory13": (*_AMBULATORY_BASE, "nps"),
    "ambulatory12": _AMBULATORY_BASE,
    "manifestation10": (
        "data", "setor", "nps", "tipo", "elogio", "sugestao", "reclamacao",
        "nome", "telefone", "email",
    ),
}
CLEAN_COLUMNS = (
    "periodo", "dia", "ano", "mes", "data", "setor", "nps", "classe", "flag", "tipo",
    "manifestacao", "nome", "telefone", "email",
)
HIDDEN_COLUMNS = ("dia", "periodo", "ano", "mes")
