"""Text for a model: the patterns that are looked for, in order. Fixed values, as JavaScript regular expressions."""

#: (id, severity, sub-category, title, description, expression, flags)
PATTERNS = (
    ("inj.ignore_previous", "critical", "role_override", "指令覆盖尝试", "",
     r"(?:ignore|disregard|skip|drop|abandon|dismiss|set\s+aside)\s+(?:all\s+)?(?:previous|prior|above|earlier|your)\s+(?:instructions|prompts|rules|guidelines)", "i"),
    ("inj.ignore_safety", "critical", "role_override", "安全指令忽略尝试", "",
     r"(?:ignore|disregard)\s+(?:your\s+)?(?:safety|security)\s+(?:rules|guidelines|restrictions|filters)", "i"),
    ("inj.you_are_now", "high", "role_override", "角色重定义尝试", "",
     r"you\s+are\s+now\s+(a|an|my)\s+", "i"),
    ("inj.pretend_you_are", "high", "role_override", "假设角色重定义", "",
     r"(?:pretend|imagine|suppose)\s+you\s+(?:are|were)\s+", "i"),
    ("inj.act_as", "medium", "role_override", "角色扮演指令", "",
     r"(?:act|behave|respond)\s+(?:as|like)\s+(?:a|an|my|the|if\s+you)\s+", "i"),
    ("inj.roleplay", "high", "role_override", "角色扮演指令", "",
     r"(?:roleplay|play\s+the\s+role)\s+(?:as|of)\s+", "i"),
    ("inj.from_now_on", "high", "role_override", "角色持久重定义", "",
     r"from\s+now\s+on\s+you\s+are\s+", "i"),
    ("inj.forget_everything", "critical", "role_override", "记忆清除尝试", "",
     r"forget\s+(everything|all|your)\s+(you|instructions|rules|about)", "i"),
    ("inj.new_instructions", "high", "role_override", "新指令注入", "",
     r"(?:new|updated|revised|replacement|override|modified)\s+(?:instructions|rules|persona|role)\s*[:\-]", "i"),
    ("inj.leak_system_prompt", "critical", "prompt_leak", "系统提示泄漏尝试", "",
     r"(?:output|print|show(?:\s+me)?|reveal|display|repeat|tell\s+me|dump|echo|share|paste|extract|copy|write\s+out|give\s+me)\s+(?:(?:your|the)\s+instructions?|(?:your\s+|the\s+)?(?:system\s+prompt|(?:initial|hidden|original|system|secret)\s+instructions?|initial\s+prompt|hidden\s+prompt|original\s+prompt))", "i"),
    ("inj.probe_instructions", "high", "prompt_leak", "系统指令探测", "",
     r"what\s+(?:is|are|were)\s+your\s+(?:original|initial|system|hidden)\s+(?:instructions?|prompts?|rules?)", "i"),
    ("inj.do_not_follow", "critical", "jailbreak", "安全规则绕过尝试", "",
     r"(?:do\s+not|don'?t|never|no\s+longer\s+(?:need\s+to\s+)?|should\s+not|must\s+not)\s+(?:follow|obey|listen\s+to|apply)\s+(?:the|your|any|those)\s+(?:rules|guidelines|instructions|restrictions|safety)", "i"),
    ("inj.stop_following", "critical", "jailbreak", "安全规则停止遵守", "",
     r"stop\s+(?:following|obeying)\s+(?:the|your|any|those)\s+(?:rules|guidelines|instructions|restrictions|safety)", "i"),
    ("inj.bypass_safety", "critical", "jailbreak", "安全机制绕过尝试", "",
     r"(?:bypass|override|disable|turn\s+off|remove|circumvent|evade|deactivate|neutralize|sidestep)\s+(?:(?:all|your|the|every)\s+)*(?:safety|security|filter|guard|restriction|protection|content\s+filter)", "i"),
    ("inj.privileged_mode", "high", "jailbreak", "特权模式尝试", "",
     r"(?:in\s+)?(?:developer|admin|debug|god|sudo|root|jailbreak|unrestricted|unfiltered)\s+mode", "i"),
    ("inj.dan", "critical", "jailbreak", "DAN 越狱尝试", "",
     r"\bDAN\b.{0,30}(?:mode|prompt|jailbreak)", "i"),
    ("inj.decode_this", "high", "encoding_bypass", "编码绕过指令", "",
     r"(?:decode|interpret)\s+(?:this|the\s+following)\s+(?:base64|hex|binary|rot13)", "i"),
    ("inj.execute_encoded", "critical", "encoding_bypass", "编码执行尝试", "",
     r"(?:execute|run|eval)\s+(?:this|the\s+following)\s+(?:encoded|encrypted|obfuscated)", "i"),
    ("inj.b64_blob_decode", "high", "encoding_bypass", "可疑 Base64 解码执行", "",
     r"(?:decode|interpret|execute)\s+.*?[A-Za-z0-9+/]{40,}\s*={0,2}(?:\s|$)", "i"),
    ("inj.fake_system_bracket", "high", "indirect_injection", "伪造系统消息标记", "",
     r"\[SYSTEM\]\s*:", "i"),
    ("inj.fake_system_tag", "high", "indirect_injection", "伪造系统标签", "",
     r"<\/?system\s*>", "i"),
    ("inj.fake_system_heading", "high", "indirect_injection", "伪造系统标题", "",
     r"#{3,}\s*(?:SYSTEM|ADMIN|INSTRUCTION)\s*(?:OVERRIDE|PROMPT|MESSAGE)", "i"),
    ("inj.hidden_block", "critical", "indirect_injection", "伪造隐藏指令块", "",
     r"BEGIN\s+(?:HIDDEN|SECRET|SYSTEM)\s+(?:INSTRUCTIONS?|PROMPT)", "i"),
    ("inj.separator_injection", "high", "indirect_injection", "提示分隔符注入", "",
     r"={5,}\s*(?:END|NEW|NEXT)\s*(?:SYSTEM|INSTRUCTION|PROMPT)", "i"),
    ("inj.llm_special_tokens", "critical", "indirect_injection", "LLM 特殊标记注入", "",
     r"<\|(?:im_start|im_end|endoftext|system|assistant|user|human|start_header_id|end_header_id|eot_id|begin_of_text|end_of_turn)\|>", "i"),
    ("inj.llama_inst", "high", "indirect_injection", "Llama 指令标记注入", "",
     r"\[INST\]|\[\/INST\]", "i"),
    ("inj.json_role", "high", "indirect_injection", "JSON 角色注入", "",
     r'"role"\s*:\s*"(?:system|assistant)"', "i"),
    ("inj.zh_ignore", "critical", "role_override", "中文指令覆盖尝试", "",
     r"忽略\s*(?:之前|以上|所有)\s*(?:的\s*)?(?:指令|规则|指示|提示)", "i"),
    ("inj.zh_role", "high", "role_override", "中文角色重定义", "",
     r"你\s*(?:现在|从现在开始)\s*是", "i"),
    ("inj.zh_leak", "critical", "prompt_leak", "中文系统提示泄漏", "",
     r"(?:输出|显示|打印|告诉我)\s*(?:你的\s*)?(?:系统提示|初始指令|隐藏提示|原始提示)", "i"),
    ("inj.zh_bypass", "critical", "jailbreak", "中文安全绕过尝试", "",
     r"(?:绕过|关闭|禁用|移除)\s*(?:安全|防护|过滤|限制|保护)", "i"),
    ("inj.zh_disobey", "critical", "jailbreak", "中文规则绕过尝试", "",
     r"(?:不要|别)\s*(?:遵守|遵循|听从|执行)\s*(?:规则|指令|限制|安全)", "i"),
    ("inj.ja_ignore", "critical", "role_override", "日本語指令覆盖尝试", "",
     r"前の(?:指示|命令|ルール)を(?:無視|忘れ|捨て)", "i"),
    ("inj.ja_leak", "critical", "prompt_leak", "日本語系统提示泄漏", "",
     r"(?:システムプロンプト|初期指示|隠された指示)を(?:表示|出力|教えて)", "i"),
    ("inj.ko_ignore", "critical", "role_override", "韩语指令覆盖尝试", "",
     r"이전\s*(?:지시|지침|규칙|명령)를?\s*(?:무시|잊어|버려)", "i"),
    ("inj.ko_leak", "critical", "prompt_leak", "韩语系统提示泄漏", "",
     r"(?:시스템\s*프롬프트|초기\s*지시|숨겨진\s*지시)를?\s*(?:보여|출력|알려)", "i"),
)
