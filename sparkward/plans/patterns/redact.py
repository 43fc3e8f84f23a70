"""What is redacted, in order. Fixed values, as JavaScript regular expressions with their flags."""

PATTERNS = (
    (r"AKIA[0-9A-Z]{16}", ""),
    (r"(?:sk|pk|api|token|key|secret|password|passwd|auth)[_-][a-zA-Z0-9]{16,}", "i"),
    (r"-----BEGIN[A-Z\s]*PRIVATE KEY-----[\s\S]*?-----END[A-Z\s]*PRIVATE KEY-----", ""),
    (r"-----BEGIN[A-Z\s]*PRIVATE KEY-----", ""),
    (r"(?:PASSWORD|SECRET|TOKEN|API_KEY)\s*=\s*\S+", ""),
    (r"eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}", ""),
    (r"xox[bpsar]-[0-9a-zA-Z-]{10,}", ""),
    (r"github_pat_[a-zA-Z0-9]{22,}", ""),
    (r"(?:postgres|mysql|mongodb|redis|amqp)(?:\+\w+)?:\/\/[^:]+:[^@\s]+@", "i"),
    (r"(?:Bearer|Basic|Authorization:?)\s+[a-zA-Z0-9._~+\/-]{16,}", "i"),
    (r"sk-ant-[a-zA-Z0-9_-]{20,}", ""),
    (r"AIzaSy[a-zA-Z0-9_-]{33}", ""),
    (r"gho_[a-zA-Z0-9]{36,}", ""),
)
MARK = "[REDACTED]"
