"""Column -> Column helpers; all run inside the JVM except `unescape_all`."""

from .dates import epoch_ms_date, parse_date_iso, parse_date_multi
from .keys import canonical_url, clean_url, host_tenant, job_id, norm_company, norm_role
from .keys import vacancy_key, vacancy_text
from .labels import age_label, card_text, escape_html, is_fresh, location_chip, location_list
from .labels import salary_label, score_band, score_dot
from .places import Gazetteer, clean_city, clean_city_table, order_cities
from .replies import build_prompt, error_class, parse_reply, reply_envelope, token_cost
from .text import collapse, html_text, strip, strip_tags, unescape_all, unescape_basic

__all__ = [n for n in dir() if not n.startswith("_")]
