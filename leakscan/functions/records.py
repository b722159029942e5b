"""Composition of incident records and the rule-based recommendation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Recommendation texts.
RECOMMENDATIONS = {
    "Critical": "НЕМЕДЛЕННО: Заблокировать отправку, уведомить службу безопасности, создать инцидент в SIEM",
    "High": "СРОЧНО: Записать в лог высокого приоритета, уведомить администратора, проверить в течение часа",
    "Medium": "ВАЖНО: Зафиксировать инцидент, уведомить ответственного, проверить в течение дня",
    "Low": "ИНФОРМАЦИЯ: Записать для статистики, проверка при плановом аудите",
}
RECOMMENDATION_OTHER = "Проверить инцидент"
DETAIL_PII = "Обнаружено %d PII"
DETAIL_EXTERNAL = "Отправка внешнему получателю - повышенный риск"
DETAIL_EMAIL = "Рекомендуется проверить получателя и содержимое вложений"
COMPANY_DOMAIN = "@company.com"
UNKNOWN_DEPARTMENT = "Unknown"


def compose_text(subject: Column, body: Column) -> Column:
    """Description of a message. Both parts are required, so run it behind validation."""
    return F.concat(subject, F.lit(". "), body)


def default_department(col: Column) -> Column:
    """A missing or empty department is reported as unknown."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(UNKNOWN_DEPARTMENT))


def is_external(recipient: Column, domain: str = COMPANY_DOMAIN) -> Column:
    """True unless the address ends in the company domain, letter case included."""
    return ~F.endswith(recipient, F.lit(domain))


def recommendation(incident_type: Column, severity: Column, pii_count: Column, external: Column) -> Column:
    """Advice by severity, followed by whatever details apply and then a full stop."""
    base = F.lit(RECOMMENDATION_OTHER)
    for level, text in RECOMMENDATIONS.items():
        base = F.when(severity == level, F.lit(text)).otherwise(base)
    found = pii_count > 0
    risky_mail = (incident_type == "email") & severity.isin("High", "Critical")
    text = F.concat_ws(
        ". ",
        base,
        F.when(found, F.format_string(DETAIL_PII, pii_count)),
        F.when(external, F.lit(DETAIL_EXTERNAL)),
        F.when(risky_mail, F.lit(DETAIL_EMAIL)),
    )
    detailed = F.coalesce(found, F.lit(False)) | F.coalesce(external, F.lit(False)) | F.coalesce(risky_mail, F.lit(False))
    return F.concat(text, F.when(detailed, F.lit(".")).otherwise(F.lit("")))


def preview(col: Column, n: int = 100) -> Column:
    """First ``n`` characters for display."""
    return F.substring(col, 1, n)
