"""The queries of this subpackage and the SQL that some are held against."""

from __future__ import annotations

from quarry.llm import chat, decontam, html_text, line_dedup, media, mixing, pii, quality, secrets, simhash


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_quality": quality.op2_quality,
        "op3_mixing": mixing.op3_mixing,
        "op4_secrets": secrets.op4_secrets,
        "op5_html_text": html_text.op5_html_text,
        "op6_simhash": simhash.op6_simhash,
        "op7_mpeg_audio": media.op7_mpeg_audio,
        "op8_pii": pii.op8_pii,
        "op9_decontamination": decontam.op9_decontamination,
        "op10_chat_formatting": chat.op10_chat_formatting,
    }


def oracle_sql() -> dict:
    return {
        "op1_line_dedup": line_dedup.SQL,
        "op3_mixing": mixing.SQL,
        "op4_secrets": secrets.SQL,
        "op9_decontamination": decontam.SQL,
        "op10_chat_formatting": chat.SQL,
    }
