"""Synthetic incident tables as column expressions over a table of keys.

Every value is a function of (key, seed, salt): the same key gives the same incident however the table is split, and
rows can be made, lost and made again on any executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.functions.draws import choice, draw, randint, weighted_choice

# Incident types and their weights, plain and enhanced variant.
TYPE_WEIGHTS = {"email": 0.50, "usb": 0.20, "cloud": 0.20, "printer": 0.10}
TYPE_WEIGHTS_ENHANCED = {"email": 0.40, "usb": 0.25, "cloud": 0.20, "printer": 0.15}
DEPARTMENTS = ["IT", "HR", "Finance", "Legal", "Sales", "Marketing", "Operations", "R&D", "Support"]
EMAIL_DOMAINS = ["company.ru", "corp.ru", "example.ru", "business.com", "enterprise.ru"]
EXTERNAL_DOMAINS = ["gmail.com", "yandex.ru", "mail.ru", "outlook.com"]
EXTERNAL_SHARE = 0.7
USB_FILE_TYPES = ["xlsx", "docx", "pdf", "csv", "txt"]
USB_FILES = [
    "Клиенты_база_2024",
    "Договоры_конфиденциальные",
    "Персональные_данные",
    "Паспорта_сотрудников",
    "Реестр_физлиц",
]
CLOUD_FILE_TYPES = ["xlsx", "docx", "pdf"]
CLOUD_FILES = ["Финансовые_данные_Q4", "Список_клиентов", "Конфиденциальный_отчет", "Персональные_данные_сотрудников"]
CLOUD_SERVICES = ["Google Drive", "Dropbox", "OneDrive", "Yandex.Disk"]
CLOUD_SERVICES_ENHANCED = ["Google Drive", "Яндекс.Диск", "OneDrive", "Dropbox"]
DOCUMENT_TYPES = ["Договор", "Анкета", "Заявление", "Согласие на обработку ПД", "Личное дело"]
PII_TYPES_EMAIL = "passport,inn,phone,card"
PII_TYPES_OTHER = "passport,inn,snils,phone,card"
DETECTED_BY = "DLP System"

# Description templates per incident type.
EMAIL_TEMPLATES = [
    "Добрый день! Высылаю данные клиента: {name}, паспорт {passport}, ИНН {inn}.",
    "Информация по договору: ФИО {name}, телефон {phone}, карта {card}.",
    "Данные для оформления: {name}, СНИЛС {snils}, паспорт {passport}.",
    "Документы клиента: паспорт {passport}, ИНН {inn}, телефон {phone}.",
]
USB_TEMPLATES = [
    "Попытка копирования файла '{file}' на USB-накопитель. Файл содержит данные: {name}, паспорт {passport}.",
    "Обнаружено копирование на USB: '{file}'. Обнаружены ПД: ФИО {name}, ИНН {inn}, СНИЛС {snils}.",
    "Попытка вывоза информации: файл '{file}' с данными {name}, телефон {phone}, карта {card}.",
]
CLOUD_TEMPLATES = [
    "Загрузка файла '{file}' в {service}. Файл содержит: {name}, паспорт {passport}, ИНН {inn}.",
    "Обнаружена синхронизация с {service}: '{file}'. Данные: {name}, телефон {phone}, СНИЛС {snils}.",
    "Попытка загрузки в {service}: '{file}' с информацией {name}, карта {card}.",
]
PRINTER_TEMPLATES = [
    "Печать документа '{document}' с данными: {name}, паспорт {passport}, ИНН {inn}.",
    "Обнаружена печать: '{document}'. Содержит ПД: {name}, телефон {phone}, СНИЛС {snils}.",
    "Попытка печати '{document}' с информацией: {name}, карта {card}, паспорт {passport}.",
]
EMAIL_TEMPLATES_ENHANCED = [
    "Добрый день, {name}! Направляю запрошенные документы в приложении.",
    "Здравствуйте! Высылаю информацию по клиенту {client}.",
    "Коллеги, во вложении отчёт за {month} месяц.",
    "Отправляю данные для проверки. Срочно нужен ответ.",
    "Привет! Скинул тебе базу клиентов на личную почту.",
    "Смотри, что нашёл в папке с зарплатами 😄",
    "Держи файлик, который просил. Никому не говори!",
    "Уважаемые коллеги, направляем сводку по персональным данным сотрудников.",
    "В соответствии с вашим запросом направляю выгрузку из CRM.",
    "Информирую о выявленных несоответствиях в документах {doc_type}.",
    "Документы во вложении.",
    "Смотри файл.",
    "Отправил как просил.",
    "База в аттаче.",
]
EMAIL_MONTHS = ["январь", "февраль", "март"]
EMAIL_DOC_TYPES = ["договоры", "акты"]
EMAIL_NAME = "коллега"
EMAIL_CLIENT = "клиента"
USB_TEMPLATES_ENHANCED = [
    "Копирование файла '{file}' на USB-накопитель",
    "Попытка записи '{file}' на внешний носитель",
    "Обнаружена передача файла '{file}' через USB",
]
CLOUD_TEMPLATES_ENHANCED = ["Загрузка '{file}' в {service}", "Синхронизация '{file}' с {service}"]
FILE_NAMES_ENHANCED = [
    "Клиенты_{date}.xlsx",
    "База_CRM_экспорт.csv",
    "Зарплаты_{month}_{year}.xlsx",
    "Договоры_архив.zip",
    "Паспортные_данные.docx",
    "Персональные_данные_сотрудников.xlsx",
    "Confidential_{random}.pdf",
    "НЕ_УДАЛЯТЬ_ВАЖНО.xlsx",
    "Финансовый_отчёт_Q{quarter}.xlsx",
    "backup_{timestamp}.sql",
]
MONTHS = [
    "Январь",
    "Февраль",
    "Март",
    "Апрель",
    "Май",
    "Июнь",
    "Июль",
    "Август",
    "Сентябрь",
    "Октябрь",
    "Ноябрь",
    "Декабрь",
]
PII_SHARE_ENHANCED = 0.6
CARD_SHARE_ENHANCED = 0.4
PASSPORT_SHARE_ENHANCED = 0.3
CARD_LABEL = "Карта: "
PASSPORT_LABEL = "Паспорт: "

# Hours of the working day and their weights, and how often days are drawn again.
HOUR_WEIGHTS = {8: 5, 9: 10, 10: 20, 11: 25, 12: 15, 13: 8, 14: 20, 15: 22, 16: 18, 17: 12, 18: 7, 19: 3}
FRIDAY_REDRAW = 0.3
WEEKEND_REDRAW = 0.7

# Typing errors, their rate per character, and the share of texts that get any.
TYPO_MAP = {"а": "о", "о": "а", "е": "и", "и": "е", "т": "т", "п": "р", "р": "п", "л": "д"}
TYPO_RATE = 0.01
TYPO_SHARE = 0.15

# Moment the tables look back from; fixed, so that a run can be repeated.
ANCHOR = "2026-01-01 12:00:00"


def fill(template: Column | str, mapping: dict[str, Column | str]) -> Column:
    """Template with every ``{placeholder}`` replaced."""
    out = template if isinstance(template, Column) else F.lit(template)
    for name, value in mapping.items():
        out = F.replace(out, F.lit("{" + name + "}"), value if isinstance(value, Column) else F.lit(value))
    return out


def _digits(u: Column, n: int) -> Column:
    """``n`` digits, leading zeros kept."""
    return F.lpad(F.floor(u * float(10**n)).cast("string"), n, "0")


def _number(u: Column, low: int, high: int) -> Column:
    return randint(u, low, high).cast("string")


def pii_payload(key: Column, seed: int) -> dict[str, Column]:
    """Personal data of a key as strings. Persons get a hashed number instead of a name."""
    u = lambda salt: draw(key, seed, salt)
    card = F.concat_ws(" ", *[_number(u(f"card{i}"), 1000, 9999) for i in range(4)])
    passport = F.concat_ws(" ", _number(u("passport0"), 1000, 9999), _number(u("passport1"), 100_000, 999_999))
    inn = F.concat(*[_digits(u(f"inn{i}"), 4) for i in range(3)])
    snils = F.concat_ws(
        " ", F.concat_ws("-", *[_number(u(f"snils{i}"), 100, 999) for i in range(3)]), _number(u("snils3"), 10, 99)
    )
    phone = F.concat(F.lit("+79"), _digits(u("phone0"), 4), _digits(u("phone1"), 5))
    name = F.concat(F.lit("Person-"), _digits(u("name"), 8))
    return {"name": name, "phone": phone, "card": card, "passport": passport, "inn": inn, "snils": snils}


def severity_rule(incident_type: Column, external: Column, sensitive: Column, u: Column) -> Column:
    """Severity label: drawn from the levels that type, recipient and content allow."""
    email = (
        F.when(external & sensitive, choice(u, ["High", "Critical"]))
        .when(external, choice(u, ["Medium", "High"]))
        .otherwise(choice(u, ["Low", "Medium"]))
    )
    return (
        F.when(incident_type == "email", email)
        .when(incident_type == "usb", choice(u, ["High", "Critical"]))
        .when(incident_type == "cloud", choice(u, ["Medium", "High", "High"]))
        .otherwise(choice(u, ["Low", "Medium", "Medium"]))
    )


def recent_ts(key: Column, seed: int, anchor: str = ANCHOR) -> Column:
    """A day among the last 90 before the anchor, at the anchor's time of day."""
    days = randint(draw(key, seed, "days"), 0, 90)
    return _days_before(anchor, days)


def _days_before(anchor: str, days: Column) -> Column:
    moment = F.lit(anchor).cast("timestamp")
    return F.timestamp_seconds(F.unix_timestamp(moment) - days * 86_400)


def synth_ts(key: Column, seed: int, anchor: str = ANCHOR) -> Column:
    """A working-hours moment of the last year; some Fridays and most weekend days are drawn again."""
    u = lambda salt: draw(key, seed, salt)
    day = lambda salt: _days_before(anchor, randint(u(salt), 1, 365))
    first = day("day0")
    weekday = F.weekday(first)
    again = ((weekday == 4) & (u("friday") < FRIDAY_REDRAW)) | ((weekday >= 5) & (u("weekend") < WEEKEND_REDRAW))
    chosen = F.when(again, day("day1")).otherwise(first)
    hour = weighted_choice(u("hour"), HOUR_WEIGHTS).cast("long")
    seconds = hour * 3600 + randint(u("minute"), 0, 59) * 60 + randint(u("second"), 0, 59)
    return F.timestamp_seconds(F.unix_timestamp(F.date_trunc("day", chosen)) + seconds)


def add_typos(text: Column, key: Column, rate: float, seed: int) -> Column:
    """Replaces letters of the typo map, each with probability ``rate``; replacements are lower case.

    One hash per character decides. The text is cut and joined only when this expression is evaluated.
    """
    source, target = "".join(TYPO_MAP), "".join(TYPO_MAP.values())
    pattern = f"[{source}{source.upper()}]"
    hit = lambda i: F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(1_000_000)) < int(rate * 1_000_000)
    changed = F.transform(
        F.split(text, ""),
        lambda c, i: F.when(F.rlike(c, F.lit(pattern)) & hit(i), F.translate(F.lower(c), source, target)).otherwise(c),
    )
    return F.array_join(changed, "")


def realistic_filename(key: Column, seed: int, anchor: str = ANCHOR) -> Column:
    u = lambda salt: draw(key, seed, salt)
    moment = F.lit(anchor).cast("timestamp")
    return fill(
        choice(u("filename"), FILE_NAMES_ENHANCED),
        {
            "date": F.date_format(moment, "dd.MM.yyyy"),
            "month": choice(u("file_month"), MONTHS),
            "year": _number(u("file_year"), 2023, 2026),
            "quarter": _number(u("file_quarter"), 1, 4),
            "random": _number(u("file_random"), 1000, 9999),
            "timestamp": F.unix_timestamp(moment).cast("string"),
        },
    )


def _address(u_user: Column, u_domain: Column, domains: list[str]) -> Column:
    return F.concat(F.lit("user"), _digits(u_user, 5), F.lit("@"), choice(u_domain, domains))


def _email_text_enhanced(key: Column, seed: int, pii: dict[str, Column]) -> Column:
    u = lambda salt: draw(key, seed, salt)
    text = fill(
        choice(u("email_template"), EMAIL_TEMPLATES_ENHANCED),
        {
            "name": EMAIL_NAME,
            "client": EMAIL_CLIENT,
            "month": choice(u("email_month"), EMAIL_MONTHS),
            "doc_type": choice(u("email_doc"), EMAIL_DOC_TYPES),
        },
    )
    some = u("some_pii") < PII_SHARE_ENHANCED
    card = F.when(some & (u("some_card") < CARD_SHARE_ENHANCED), F.concat(F.lit(CARD_LABEL), pii["card"]))
    passport = F.when(some & (u("some_passport") < PASSPORT_SHARE_ENHANCED), F.concat(F.lit(PASSPORT_LABEL), pii["passport"]))
    listed = F.concat_ws(", ", card, passport)
    return F.when(listed == "", text).otherwise(F.concat(text, F.lit(" "), listed, F.lit(".")))


def synth_over(df: DataFrame, key: str, seed: int = 42, enhanced: bool = False, anchor: str = ANCHOR) -> DataFrame:
    """One incident per row of a table with a unique key: the key and the incident columns.

    Type-specific columns are null for other types. The enhanced variant uses business-like texts and file names,
    working-hours times (none for printers, which also have no incident id) and typing errors.
    """
    k = F.col(key)
    u = lambda salt: draw(k, seed, salt)
    pii = pii_payload(k, seed)

    # Drawn values become columns first: each is used by several of the texts.
    base = df.select(key).withColumns(
        {
            "incident_type": weighted_choice(u("type"), TYPE_WEIGHTS_ENHANCED if enhanced else TYPE_WEIGHTS),
            "_external": u("external") < EXTERNAL_SHARE,
            "_email_body": choice(u("email_body"), EMAIL_TEMPLATES),
            **{f"_{name}": value for name, value in pii.items()},
        }
    )
    kind = F.col("incident_type")
    is_usb, is_cloud, is_email, is_printer = (kind == t for t in ("usb", "cloud", "email", "printer"))
    base = base.withColumns(
        {
            "file_type": F.when(is_usb, choice(u("file_type"), USB_FILE_TYPES)).when(
                is_cloud, choice(u("file_type"), CLOUD_FILE_TYPES)
            ),
            "cloud_service": F.when(is_cloud, choice(u("service"), CLOUD_SERVICES)),
            "document_type": F.when(is_printer, choice(u("document"), DOCUMENT_TYPES)),
            "is_external_recipient": F.when(is_email, F.col("_external")),
        }
    )
    stem = F.when(is_usb, choice(u("file"), USB_FILES)).otherwise(choice(u("file"), CLOUD_FILES))
    base = base.withColumn("file_name", F.when(is_usb | is_cloud, F.concat(stem, F.lit("."), F.col("file_type"))))

    held = {name: F.col(f"_{name}") for name in pii}
    printer_text = fill(choice(u("printer_template"), PRINTER_TEMPLATES), {**held, "document": F.col("document_type")})
    if enhanced:
        name = {"file": realistic_filename(k, seed, anchor)}
        service = {"service": choice(u("service_text"), CLOUD_SERVICES_ENHANCED)}
        email_text = _email_text_enhanced(k, seed, held)
        email_text = F.when(u("typos") < TYPO_SHARE, add_typos(email_text, k, TYPO_RATE, seed)).otherwise(email_text)
        usb_text = fill(choice(u("usb_template"), USB_TEMPLATES_ENHANCED), name)
        cloud_text = fill(choice(u("cloud_template"), CLOUD_TEMPLATES_ENHANCED), {**name, **service})
        timestamp = F.when(~is_printer, synth_ts(k, seed, anchor))
    else:
        email_text = fill(F.col("_email_body"), held)
        usb_text = fill(choice(u("usb_template"), USB_TEMPLATES), {**held, "file": F.col("file_name")})
        cloud_text = fill(
            choice(u("cloud_template"), CLOUD_TEMPLATES),
            {**held, "file": F.col("file_name"), "service": F.col("cloud_service")},
        )
        timestamp = recent_ts(k, seed, anchor)

    body = F.lower(F.col("_email_body"))
    sensitive = F.contains(body, F.lit("паспорт")) | F.contains(body, F.lit("карта"))
    recipient = F.when(F.col("_external"), _address(u("recipient"), u("recipient_domain"), EXTERNAL_DOMAINS)).otherwise(
        _address(u("recipient"), u("recipient_domain"), EMAIL_DOMAINS)
    )
    text = F.when(is_email, email_text).when(is_usb, usb_text).when(is_cloud, cloud_text).otherwise(printer_text)
    incident_id = F.concat(F.lit("INC-"), F.when(k < 1_000_000, F.lpad(k.cast("string"), 6, "0")).otherwise(k.cast("string")))
    return base.select(
        key,
        (F.lit(None).cast("string") if enhanced else incident_id).alias("incident_id"),
        timestamp.alias("timestamp"),
        "incident_type",
        severity_rule(kind, F.col("_external"), sensitive, u("severity")).alias("severity"),
        text.alias("description"),
        choice(u("department"), DEPARTMENTS).alias("department"),
        F.concat(F.lit("user-"), _digits(u("user"), 6)).alias("user"),
        F.lit(True).alias("contains_pii"),
        F.when(is_email, PII_TYPES_EMAIL).otherwise(PII_TYPES_OTHER).alias("pii_types"),
        F.lit(None if enhanced else DETECTED_BY).cast("string").alias("detected_by"),
        F.when(is_email, _address(u("sender"), u("sender_domain"), EMAIL_DOMAINS)).alias("sender"),
        F.when(is_email, recipient).alias("recipient"),
        "is_external_recipient",
        "file_name",
        "file_type",
        "cloud_service",
        "document_type",
    )


def synth_incidents(spark: SparkSession, n: int = 1000, seed: int = 42, enhanced: bool = False) -> DataFrame:
    """``n`` incidents numbered from 1, in the incident schema."""
    return synth_over(spark.range(1, n + 1).withColumnRenamed("id", "_key"), "_key", seed, enhanced).drop("_key")
