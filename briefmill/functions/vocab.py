"""Vocabularies, names and thresholds that results depend on."""

from __future__ import annotations

# The keys of a design output.
REQUIRED_KEYS = ["context_summary", "kpi_chart_mapping", "layout", "styling", "interactions", "rationales"]

# Analytical tasks and chart types; their order decides which one a shared prefix means.
TASKS = ["trend", "comparison", "composition", "distribution", "correlation", "ranking", "deviation", "part_to_whole", "flow"]
CHARTS = ["line", "bar", "stacked_bar", "grouped_bar", "area", "pie", "donut", "scatter", "heatmap", "histogram", "box", "kpi_card", "table", "gauge", "sankey", "treemap", "map"]

# Other spellings of tasks and charts.
TASK_ALIASES = {
    "comparision": "comparison",
    "comparative": "comparison",
    "compoation": "composition",
    "part-to-whole": "part_to_whole",
    "part to whole": "part_to_whole",
    "temporal": "trend",
    "time series": "trend",
    "deviation analysis": "deviation",
    "rank": "ranking",
}
CHART_ALIASES = {
    "kpi card": "kpi_card",
    "kpi_card / scorecard": "kpi_card",
    "kpi card / scorecard": "kpi_card",
    "scorecard": "kpi_card",
    "grouped bar": "grouped_bar",
    "stacked bar": "stacked_bar",
    "line graph": "line",
    "bar graph": "bar",
    "column chart": "bar",
    "column": "bar",
    "bubble": "scatter",
    "funnel": "sankey",
    "waterfall": "bar",
    "bullet": "gauge",
}

# Words that a paraphrase swaps.
SYNONYMS = {
    "show": "display",
    "display": "show",
    "track": "monitor",
    "monitor": "track",
    "compare": "contrast",
    "analyze": "examine",
    "analyse": "examine",
    "identify": "detect",
    "understand": "interpret",
    "view": "see",
    "goal": "objective",
    "goals": "objectives",
    "key": "main",
    "metric": "measure",
    "metrics": "measures",
    "across": "over",
    "overview": "summary",
}

# Fixed value: signs that a text asks for clarification.
CLARIFY = (
    r"clarif|more (info|information|detail|context)|unclear|ambiguous|insufficient|"
    r"cannot (determine|tell|recommend)|can't (determine|tell)|not enough|need (more|to know)|"
    r"please (provide|specify|share)|uncertain|unsure|missing (data|info|information|column|kpi)|"
    r"underspecified|under-specified|no (kpi|goal|data|column)"
)

# Dimensions of the human rating rubric, with labels; scores run from 1 to 5.
RUBRIC = {
    "chart_appropriateness": "Chart appropriateness",
    "layout_quality": "Layout & hierarchy",
    "styling_accessibility": "Styling & accessibility",
    "interaction_design": "Interaction design",
    "rationale_quality": "Rationale quality",
    "overall_usefulness": "Overall usefulness",
}
LIKERT = (1, 5)

# Task -> chart that suits it best, and others that do.
TASK_CHART = {
    "trend": ("line", ["area"]),
    "comparison": ("bar", ["grouped_bar", "table"]),
    "composition": ("stacked_bar", ["area"]),
    "part_to_whole": ("donut", ["pie", "treemap"]),
    "distribution": ("histogram", ["box"]),
    "correlation": ("scatter", ["heatmap"]),
    "ranking": ("bar", ["table"]),
    "deviation": ("bar", ["table"]),
    "flow": ("sankey", ["table"]),
}

# Words in a KPI's name that tell its task; the first rule that matches holds.
KEYWORD_TASK = [
    (["funnel", "pipeline", "stage", "onboarding", "acquisition"], "flow"),
    (["by region", "by category", "by segment", "by product", "by channel", "mix", "share", "breakdown"], "part_to_whole"),
    (["distribution", "spread", "range"], "distribution"),
    (["loss", "driver", "deviation", "variance", "change"], "deviation"),
    (["vs", "correlation", "relationship", "impact"], "correlation"),
    (["rate", "ratio", "conversion", "churn", "margin", "score", "utilization"], "comparison"),
    (["revenue", "sales", "traffic", "volume", "demand", "usage", "visits", "users", "load"], "trend"),
]

# Thresholds of grounding, of valid top-3, of low reliability, and of effect sizes.
LEXICAL_SUPPORT, SEMANTIC_SUPPORT = 0.2, 0.5
TOP3_VALID = 0.5
LOW_ALPHA = 0.667
CLIFF = [(0.147, "negligible"), (0.33, "small"), (0.474, "medium")]

# Sections of an output as raters see it (title, key, form), the head of its table, and what stands for an output that
# could not be parsed.
SECTIONS = [
    ("Context summary", "context_summary", "pairs"),
    ("KPI → chart mapping", "kpi_chart_mapping", "table"),
    ("Layout", "layout", "pairs"),
    ("Styling", "styling", "pairs"),
    ("Interactions", "interactions", "items"),
    ("Rationales", "rationales", "reasons"),
]
TABLE_HEAD = ["", "| KPI | Task | Chart | Alternatives |", "|---|---|---|---|"]
RAW_LEAD = "_Could not parse a structured recommendation; raw model output:_\n\n```\n"
NO_OUTPUT = "(no output produced)"
RAW_CHARS = 4000

# Labels of a brief's fields, what stands for those that are missing, and what stands around brief and output in a
# judge's prompt.
BRIEF_LABELS = {"users": "Users", "goals": "Goals", "kpis": "KPIs", "columns": "Data columns", "constraints": "Constraints"}
MISSING, NO_CONSTRAINTS, NO_BRIEF = "N/A", "None", "(brief unavailable)"
JUDGE_PARTS = ("\n\nDimensions:\n", "\n\nBRIEF:\n", "\n\nRECOMMENDATION:\n", "\n\nJSON scores:")

# Texts of prompts.
SYSTEM_PROMPT = (
    "You are an expert dashboard design consultant.\n"
    "Given a dashboard brief, you generate structured, professional design recommendations.\n"
    "Always respond with a single valid JSON object following the exact schema provided."
)
USER_OPENING = "Please generate a structured dashboard design recommendation for the following brief:"
USER_KEYS = "Respond ONLY with a valid JSON object containing exactly these keys:"
USER_MAPPING = "In kpi_chart_mapping, each entry has: kpi, task_type, chart_type, alternatives (list), encoding (object)."
USER_RATIONALES = "rationales is a list of objects, each with: claim, principle."
JUDGE_OPENING = (
    "You are an expert dashboard-design reviewer. Rate the RECOMMENDATION for the given BRIEF on each dimension "
    "from 1 (poor) to 5 (excellent). Think briefly, then output ONLY a JSON object mapping each dimension to an integer 1-5."
)

# English words that retrieval leaves out: a short list of our own, passed as a parameter wherever it is used.
STOP_WORDS = "a about after all also an and any are as at be been but by can could did do for from had has have how if in into is it its more most no not of on or other our out over so some such than that the their them then there these they this to up was were what when which who will with would you your".split()
