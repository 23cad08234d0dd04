"""Rule packs: word lists, patterns and replacements. A pack is a parameter of every function that needs one.

`PLAIN` rewrites nothing and is the default. `VIDEO` holds the vocabulary of one series of screen recordings;
whoever wants the reports of such videos passes it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Replacements of known terms, in the order they apply (case does not matter).
KNOWN_TERMS = [
    (r"OBZ硬支撑", "Obsidian 知识库"),
    (r"OBZ\s*硬支撑", "Obsidian 知识库"),
    (r"OBZ店", "Obsidian"),
    (r"upc店", "Obsidian"),
    (r"UPC店", "Obsidian"),
    (r"UpVDN", "Obsidian"),
    (r"OpenCore", "OpenClaw"),
    (r"OpenCloud", "OpenClaw"),
    (r"OpenCall", "OpenClaw"),
    (r"Cloud Code", "Claude Code"),
    (r"CloudeCode", "Claude Code"),
    (r"ClaudeCode", "Claude Code"),
    (r"Openclaw", "OpenClaw"),
    (r"openclaw", "OpenClaw"),
    (r"\bAl\b", "AI"),
    (r"日治", "日志"),
    (r"摘药", "摘要"),
    (r"说箭甲", "收藏夹"),
    (r"按卷", "案卷"),
    (r"按键", "案件"),
    (r"避荒流程", "闭环流程"),
    (r"上下闻", "上下文"),
    (r"对话光", "对话框"),
]

# Replacements of common misreadings, in the order they apply (case does not matter), and of names
# that were read with a gap after them.
MISREADINGS = [
    (r"\b0bsidion\b", "Obsidian"),
    (r"\b0bsidian\b", "Obsidian"),
    (r"\bObsjidion\b", "Obsidian"),
    (r"\bobsidion\b", "Obsidian"),
    (r"\bobsidian\b", "Obsidian"),
    (r"\bCloudeCode\b", "ClaudeCode"),
    (r"\bCloudeCooe\b", "ClaudeCode"),
    (r"\bClaudeCodet\b", "ClaudeCode"),
    (r"\bClaude Code\b", "Claude Code"),
    (r"\b0Denclow\b", "OpenClaw"),
    (r"\bOpenclaw\b", "OpenClaw"),
    (r"\bopenclaw\b", "OpenClaw"),
    (r"\bAl\b", "AI"),
    (r"\bX-Al-Studio\b", "x-AI-Studio"),
    (r"\bx-Al-Studio\b", "x-AI-Studio"),
    (r"\bX-LLM-Wiki\b", "x-LLM-Wiki"),
]
GAPPED_NAMES = ["Obsidian", "ClaudeCode", "OpenClaw"]

# Terms that speak for a line of recognised text.
USEFUL_TERMS = ["Obsidian", "Claude", "OpenClaw", "Action", "Card", "Time", "LLM", "AI", "Homepage", "CLAUDE"]

# hosts' media suffixes and types.
SUFFIXES = [".mp4", ".mov", ".mkv", ".webm", ".m4v", ".avi"]
MEDIA_TYPES = {
    "video/mp4": ".mp4",
    "video/quicktime": ".mov",
    "video/webm": ".webm",
    "video/x-matroska": ".mkv",
    "video/x-msvideo": ".avi",
}

# Hosts of shortened addresses, browsers that cookies are taken from, hosts of short-video sites.
SHORT_HOSTS = ["v.douyin.com", "vm.tiktok.com", "vt.tiktok.com"]
BROWSERS = ["chrome", "edge", "firefox"]
SHORT_VIDEO_SITES = ["douyin.com", "iesdouyin.com", "tiktok.com"]

# Tips after a failed download, by what the error holds.
REWRITTEN_TIP = "已将网页入口规范化为可下载器识别的视频页："
SITE_TIP = "抖音/短视频平台通常需要新鲜浏览器登录态，公开网页能打开不代表下载器能直接取到视频。"
ERROR_TIPS = [
    ("fresh cookies", "当前站点要求 fresh cookies：请先在浏览器里打开并确认能播放，再重试 `--cookies-from-browser chrome` 或 `--cookies-from-browser edge`。"),
    ("could not copy chrome cookie database", "浏览器 cookie 数据库暂时无法复制：请完全退出 Chrome/Edge 后重试，或导出 Netscape 格式 `cookies.txt` 后用 `--cookies <cookies.txt>`。"),
    ("failed to decrypt with dpapi", "Windows DPAPI 没能解密浏览器 cookies：这通常和 Chromium 的本机加密/运行身份有关。最稳的做法是用浏览器扩展导出 Netscape 格式 `cookies.txt`，再用 `--cookies <cookies.txt>`。"),
    ("failed to decrypt with dpapi", "如果你有 Firefox 登录态，也可以尝试 `--cookies-from-browser firefox`，它有时能避开 Chromium DPAPI 限制。"),
    ("could not find firefox cookies database", "没有找到 Firefox cookie 配置；如果你不用 Firefox，可以忽略这一项。"),
    ("unsupported url", "当前 URL 不是下载器支持的页面形态；可以尝试复制分享链接、标准视频页链接，或先下载成本地 mp4。"),
]
OTHER_TIP = "可以尝试提供本地视频文件、直连 mp4 地址，或带登录态的 cookies.txt。"

# Chunk titles; the first rule whose groups each have a word in the text gives the title.
CHUNK_TITLES = [
    ([["长期记忆", "笔记类型", "任务笔记", "卡片笔记"]], "知识库作为长期记忆"),
    ([["Claude Code"], ["发动机", "深度工作", "上下文"]], "Claude Code 负责深度工作"),
    ([["OpenClaw"], ["飞书", "微信", "入口"]], "OpenClaw 作为移动入口"),
    ([["收藏", "公众号", "视频链接"]], "资料收藏与处理"),
    ([["日志", "任务", "总结"]], "日志与任务管理"),
    ([["律师", "案卷", "办案"]], "律师场景案例"),
    ([["复利", "越来越懂你"]], "记录带来 AI 复利"),
    ([["微信", "飞书"]], "通过聊天入口连接知识库"),
]
OTHER_TITLE = "口播片段"

# What is said of a chunk with such a title.
CHUNK_SUMMARIES = {
    "知识库作为长期记忆": "用 Obsidian 承载任务、卡片和时间三类笔记，让 AI 能读取个人经验、目标和工作规则。",
    "Claude Code 负责深度工作": "Claude Code 更适合写文章、分析资料、做方案等长上下文深度工作，因为它能调用整套知识库。",
    "OpenClaw 作为移动入口": "OpenClaw 更像随手可用的轻量入口，通过微信和飞书接收想法、资料和任务，再写回 Obsidian。",
    "资料收藏与处理": "把文章或视频链接发给 Agent 后，它先做摘要，再结合用户补充的想法保存为可复用资料。",
    "日志与任务管理": "用户可以直接语音说出当天事项，Agent 负责判断内容应进入任务笔记还是日志。",
    "律师场景案例": "律师客户把案卷、复盘和裁判数据结构化进知识库，让 AI 辅助画像、评估和沟通策略。",
    "记录带来 AI 复利": "记录越多，知识库越丰富，AI 可调用的上下文也越完整，系统价值会持续累积。",
    "通过聊天入口连接知识库": "用户不需要频繁打开笔记软件，而是在熟悉的聊天入口里完成记录、管理和调用。",
}

# Points of a talk, (kind, words of which one is said, point), in order.
SPEECH_POINTS = [
    ("points", ["Obsidian"], "Obsidian 是这套系统的长期记忆，负责沉淀任务、卡片、时间计划和个人经验。"),
    ("tools", ["Obsidian"], "Obsidian：统一保存知识、任务、日志、规则和案例资料。"),
    ("points", ["Claude Code"], "Claude Code 的价值在于长上下文深度工作，不是凭空生成，而是调用已有知识库组织内容。"),
    ("tools", ["Claude Code"], "Claude Code：更像专家顾问，用于写作、资料分析、方案和 PPT 等深度任务。"),
    ("points", ["OpenClaw"], "OpenClaw 的价值在于轻量、随手、移动端入口，适合接收想法、链接、日志和任务。"),
    ("tools", ["OpenClaw"], "OpenClaw：更像瑞士军刀，通过微信和飞书连接 Obsidian。"),
    ("methods", ["微信", "飞书"], "把微信和飞书作为输入入口，降低记录成本，让用户不用改变原本的沟通习惯。"),
    ("methods", ["任务笔记", "卡片笔记", "时间笔记"], "知识库底层分成任务笔记、卡片笔记、时间笔记，让 AI 能分别理解行动、知识和计划。"),
    ("methods", ["规则文件", "核心流程"], "把工作方法沉淀成规则文件，让 Agent 知道如何读取、判断、归档和调用内容。"),
    ("methods", ["收藏", "公众号", "视频链接"], "资料输入后先由 Agent 摘要，再追加用户自己的理解，最后保存进知识库。"),
    ("methods", ["日志", "每天下午四点"], "通过定时提醒和语音输入收集每日记录，再由 Agent 自动拆解到任务或日志。"),
    ("cases", ["律师", "案卷"], "律师客户可把案卷、复盘和裁判数据结构化，辅助后续谈案、办案和复盘。"),
    ("points", ["复利", "越来越懂你"], "这套系统的核心收益是复利：记录越多，AI 越懂用户，后续调用越精准。"),
]

# Words that speak for and against a document in a frame, and of a frame full of controls.
DOCUMENT_TERMS = ["为什么", "所以", "第一层", "第二层", "Architecture", "Patterns", "Abstractions", "失控", "扛住", "规则", "知道", "问题", "系统架构", "读者", "目标读者", "痛点"]
CONTROL_TERMS = ["文件 列表", "Homepage", "x-AI-Studio", "x-LLM-Wiki", "ChatGPT", "课程", "4000+", "正在 销售", "同步 拼车", "查看 评论 区", "粉丝", "付费 会 员"]
FRAME_CONTROL_TERMS = ["ChatGPT", "Homepage", "课程", "评论区", "点赞", "粉丝", "收藏", "转发", "文件列表", "播放"]

# Lines that are no document's (the second pattern whatever the case).
NAVIGATION_LINE = r"(介绍|Obsidian使用|ClaudeCode使用|OpenClaw使用|案例拓展)"
CONTROL_LINE = r"(backlink|words|characters|ChatGPT|OpenAI|可能会犯错|文件 列表|Homepage|正在 销售|4000\+)"

# Repairs of a document's line, in the order they apply (case does not matter).
LINE_REPAIRS = [
    (r"\bAi\b", "AI"),
    (r"\bAlI\b", "AI"),
    (r"\bAEP\b", "律师客户"),
    (r"AI 越 恒 你", "AI 越懂你"),
    (r"这 是", "这是"),
    (r"选 题", "选题"),
    (r"思 路", "思路"),
    (r"内 容", "内容"),
    (r"系 统", "系统"),
    (r"架 构", "架构"),
    (r"读 者", "读者"),
    (r"使 用", "使用"),
    (r"文 件", "文件"),
    (r"知 道", "知道"),
    (r"问 题", "问题"),
    (r"任 务", "任务"),
    (r"日 志", "日志"),
    (r"卡 片", "卡片"),
    (r"微 信", "微信"),
    (r"飞 书", "飞书"),
    (r"一 一", "——"),
]
# Ends that make a short line a heading.
HEADING_END = r"(Architecture|Patterns|Abstractions|失控|扛住|为什么|是什么)$"

# Fragments that are left out, and repairs of fragments in the order they apply (case does not matter).
BROKEN_FRAGMENTS = [
    r"^05\s*薄弱$",
    r"^SRR\s+Wand",
    r"^话，\s*完展开$",
    r"^入\s*日",
    r"^AI\s*取\s*后\s*做\s*什么$",
    r"^的\s+Obsidian\s+工作\s+规则",
    r"Obsidian\s*工作\s*规则.*知道\s*本\s*周\s*重\s*点\s*是\s*什么",
    r"^想是知识底层",
    r"^笔记\s*-?20-Card/?$",
    r"^日志\s*[~\-]\s*30-Time/?$",
    r"^点\s*[“\"]?知道",
]
FRAGMENT_REPAIRS = [
    (r"这是一个选题思，内容还比较框架性", "这是一个选题思路，内容还比较框架性。"),
    (r"看完了。\s*这是一个选题思，\s*内容还比较框架性", "看完了。这是一个选题思路，内容还比较框架性。"),
    (r"强的地方", "强的地方："),
    (r"三 个使用场景辑清晰层次感|三个使用场景辑清晰层次感", "三个使用场景逻辑清晰，有层次感。"),
    (r"录越多，AI越懂你", "记录越多，AI越懂你"),
    (r"录\s*越\s*多，\s*AI\s*越懂你", "记录越多，AI越懂你"),
    (r"这个结论有潜力成为爆点", "这个结论有潜力成为爆点。"),
    (r"^[\"“]?\s*记录越多，AI越懂你\s*[\"”]?", "“记录越多，AI 越懂你”"),
    (r"系统架构部分对.*?太抽象.*?OpenClaw 是什么 \?Claude 在这里做什么角色 \?", "系统架构部分太抽象：OpenClaw 是什么？Claude 在这里做什么角色？"),
    (r"文件夹分区处理 \* 律师案例只有一句，.*?内容现在没", "文件夹分区处理和律师案例需要展开：律师案例才是最值钱的内容，但现在没有展开。"),
    (r"三 个场景写的是功能描，缺少", "三个场景写的是功能描述，缺少"),
    (r"三个场景写的是功能描，\s*缺少", "三个场景写的是功能描述，缺少"),
    (r"\"智能工作系统 \"\s*的痛点没有写 —— 读者为什么需要这个 \? 现在的工作方式有什么问题 \?", "“智能工作系统”的痛点没有写：读者为什么需要这个？现在的工作方式有什么问题？"),
    (r"三个场景写的是功能描述，缺少 \"之前 vs 之后 \"的对，\s*读者感知不到价值。", "三个场景写的是功能描述，缺少“之前 vs 之后”的对比，读者感知不到价值。"),
    (r"这篇文章的目标读者是谁？ 是想面向普通职场人还是笔记爱好、\s*还是已经在用 AI 工具的人 \?", "这篇文章的目标读者是谁？是普通职场人、笔记爱好者，还是已经在用 AI 工具的人？"),
    (r"之前 vs 之后", "之前 vs 之后"),
    (r"读者感知不到价值", "读者感知不到价值。"),
    (r"一个问题", "一个问题："),
    (r"这篇文章的目标读者是谁 \?", "这篇文章的目标读者是谁？"),
    (r"目标受众不，\s*个切入角差很多", "目标受众不同，切入角度会差很多。"),
    (r"这是一个新的内容选", "这是一个新的内容选题"),
    (r"请你保存\s*在我的文件夹下的\s*\"?\s*选题\s*\"?\s*当中", "请你保存在我的文件夹下的“选题”当中。"),
    (r"具体我讲的选是以我的点为数据结", "具体选题是：以我的知识点为底层数据，结合 Claude 和 OpenClaw 作为中间的 Agent，"),
    (r"具体选题是：以我的知识点为底层数据，结合 Claude 和 OpenClaw 作为中间的 Agent，再加上飞书和微信作为信息通讯入口，$", "具体选题是：以我的知识点为底层数据，结合 Claude 和 OpenClaw 作为中间的 Agent，再加上飞书和微信作为信息通讯入口，从而打造一套智能工作系统。"),
    (r"再加上飞和信作为信息通讯", "再加上飞书和微信作为信息通讯入口，"),
    (r"从而打造一套智能工作系统", "从而打造一套智能工作系统。"),
    (r"对照你的12周目标和周计划，知道现在应该优先", "对照你的 12 周目标和周计划，知道现在应该优先处理什么。"),
    (r"对照你的 12 周目标和周计划，\s*知道现在应该优先$", "对照你的 12 周目标和周计划，知道现在应该优先处理什么。"),
    (r"学习你最近学了什么", "知道你最近学了什么。"),
    (r"读 取卡片笔记，了解你当前的知识积累和思考线|读取卡片笔记，了解你当前的知识积累和思考线", "读取卡片笔记，了解你当前的知识积累和思考线。"),
    (r"读取卡片笔记，\s*了解你当前的知识积累和思考线$", "读取卡片笔记，了解你当前的知识积累和思考线。"),
    (r"分析任务笔记中的卡点记录提前预警可能踩的 \+", "分析任务笔记中的卡点记录，提前预警可能踩的坑。"),
    (r"存档.*知道文件要保存在哪", "知道文件要保存在哪。"),
    (r"按照规则的约定自动将内容归档到正确人", "按照规则约定，自动将内容归档到正确位置。"),
]

# Repairs of a whole document, in the order they apply (case does not matter).
DOCUMENT_REPAIRS = [
    (r"三个场景写的是功能描述，缺少\s*[\"“]\s*之前 vs 之后\s*[\"”]\s*的对[，,]\s*读者感知不到价值。", "三个场景写的是功能描述，缺少“之前 vs 之后”的对比，读者感知不到价值。"),
    (r"这篇文章的目标读者是谁？\s*是想面向普通职场人还是笔记爱好[、者]*\s*还是已经在用 AI 工具的人 \?\s*目标受众不同，切入角度会差很多。", "这篇文章的目标读者是谁？是普通职场人、笔记爱好者，还是已经在用 AI 工具的人？目标受众不同，切入角度会差很多。"),
    (r"具体选题是：以我的知识点为底层数据，结合 Claude 和 OpenClaw 作为中间的 Agent，再加上飞书和微信作为信息通讯入口，\s*$", "具体选题是：以我的知识点为底层数据，结合 Claude 和 OpenClaw 作为中间的 Agent，再加上飞书和微信作为信息通讯入口，从而打造一套智能工作系统。"),
    (r"这是我的一个文章思路，\s*你先查看一下", "这是我的一个文章思路，你先查看一下。"),
    (r"内容还比较框架性。", "内容还比较框架性。"),
]

# Words that open a part of a structured document, the parts' headings in order, and what makes a line
# of a part an item or code.
PART_TRIGGERS = [
    ("source", ["这是一个新的内容选题", "具体选题是", "从而打造一套智能工作系统"]),
    ("review", ["看完了", "强的地方", "目标读者", "痛点"]),
    ("rules", ["12 周目标", "10-Action", "30-Time", "归档", "卡片笔记"]),
]
PART_HEADINGS = {"review": "## 文章思路评审", "source": "## 原始选题内容", "rules": "## Obsidian 工作规则"}
REVIEW_ITEM = r"(有真实落地案例|逻辑清晰|记录越多|太抽象|痛点|目标读者|之前 vs 之后|律师案例|功能描述)"
RULE_CODE = r"10-Action|20-Card|30-Time"
RULE_ITEM = r"^(知道|对照|读取|分析|按照)"

# Uncertainties that are left out: in each rule every group must have one of its words in the line;
# words of the first group of the first and third rule are looked for whatever the case. The number is the
# least end of the transcript for which the rule holds.
STALE_UNCERTAINTIES = [
    (0.0, [["opencore", "cloud code", "obz", "upvdn"], ["工具名称", "识别误差", "误识别"]]),
    (480.0, [["后半段", "6 分钟后", "6分钟后"], ["口播", "转写"], ["不完整", "没有完整", "更多依赖"]]),
    (0.0, [["ocr", "文件名", "人名", "文章名"], ["误差", "只能把握大意", "不能保证逐字准确"]]),
    (0.0, [["作者名字", "Kevin", "Kiven"], ["无法完全确认", "哪种为准"]]),
    (0.0, [["手机聊天对象", "机器人名称", "阿探", "万能小龙哥"], ["同一个 Agent", "不同助手", "不能确认"]]),
    (0.0, [["课程页", "主页", "销售页", "宣传页"], ["无法", "不能", "不确定", "100%"]]),
]
ANY_CASE_WORDS = ["opencore", "cloud code", "obz", "upvdn", "ocr"]
NO_UNCERTAINTY = "未发现会影响主结论的明显不确定性；少量小字、文件名或人名仍可能存在逐字误差。"

# Navigation labels in order with the middle each is expected at (a share of the width), the readings that
# stand for one (the first that is held decides), and the bounds of their segments.
NAV_LABELS = ["浠嬬粛", "obsidian浣跨敤", "claudecode浣跨敤", "openclaw浣跨敤", "妗堜緥鎷撳睍"]
NAV_CENTERS = [0.075, 0.245, 0.47, 0.71, 0.925]
NAV_READINGS = [
    ("claudecode浣跨敤", "claudecode浣跨敤"),
    ("claudecde浣跨敤", "claudecode浣跨敤"),
    ("claudecode", "claudecode浣跨敤"),
    ("openclaw浣跨敤", "openclaw浣跨敤"),
    ("openclaw", "openclaw浣跨敤"),
    ("obsidian浣跨敤", "obsidian浣跨敤"),
    ("obsidian", "obsidian浣跨敤"),
    ("妗堜緥鎷撳睍", "妗堜緥鎷撳睍"),
    ("妗堜緥鎵╁睍", "妗堜緥鎷撳睍"),
    ("浠嬬粛", "浠嬬粛"),
]
NAV_BOUNDS = [(0.0, 0.15), (0.15, 0.34), (0.34, 0.58), (0.58, 0.85), (0.85, 1.0)]

# Titles of a report's six sections, as they may stand after a number.
SECTION_TITLES = [
    "Summary", "One-paragraph summary", "Timeline", "Key spoken points", "Key visual events", "Visible on-screen text",
    "On-screen text / OCR", "Visible text", "Uncertainties", "一句话总结", "一段总结", "总结", "时间线", "关键口播点", "关键发言点",
    "关键画面事件", "关键视觉事件", "可见文字", "画面可见文字", "屏幕可见文字", "屏幕文字", "不确定性", "不确定性与限制",
]

# Regions that text is read from, as (name, left, top, right, bottom) shares of a frame.
REGIONS = [
    ("full", 0.0, 0.0, 1.0, 1.0),
    ("main", 0.08, 0.06, 0.94, 0.92),
    ("top_title", 0.0, 0.0, 1.0, 0.36),
    ("left_sidebar", 0.0, 0.0, 0.34, 1.0),
    ("center_content", 0.22, 0.05, 0.95, 0.9),
    ("bottom_nav", 0.0, 0.86, 1.0, 1.0),
]
DOCUMENT_REGION = (0.10, 0.09, 0.80, 0.78)

# Thresholds of the change filter.
LAYOUT_THRESHOLD, TITLE_THRESHOLD = 0.18, 0.35
SAME_CHAPTER = {"gap": 10.0, "combined": 0.46, "structure": 0.115, "edge": 0.14, "localized": 0.14}


@dataclass(frozen=True)
class RulePack:
    """What a series of videos adds to the general rules. Empty fields change nothing."""

    known_terms: list = field(default_factory=list)
    misreadings: list = field(default_factory=list)
    gapped_names: list = field(default_factory=list)
    useful_terms: list = field(default_factory=list)
    chunk_titles: list = field(default_factory=list)
    other_title: str = OTHER_TITLE
    chunk_summaries: dict = field(default_factory=dict)
    speech_points: list = field(default_factory=list)
    document_terms: list = field(default_factory=list)
    control_terms: list = field(default_factory=list)
    frame_control_terms: list = field(default_factory=list)
    refused_lines: list = field(default_factory=list)
    line_repairs: list = field(default_factory=list)
    heading_end: str = ""
    broken_fragments: list = field(default_factory=list)
    fragment_repairs: list = field(default_factory=list)
    document_repairs: list = field(default_factory=list)
    part_triggers: list = field(default_factory=list)
    part_headings: dict = field(default_factory=lambda: dict(PART_HEADINGS))
    review_item: str = ""
    rule_code: str = ""
    rule_item: str = ""
    stale_uncertainties: list = field(default_factory=list)


PLAIN = RulePack()
VIDEO = RulePack(
    known_terms=KNOWN_TERMS, misreadings=MISREADINGS, gapped_names=GAPPED_NAMES, useful_terms=USEFUL_TERMS, chunk_titles=CHUNK_TITLES,
    chunk_summaries=CHUNK_SUMMARIES, speech_points=SPEECH_POINTS, document_terms=DOCUMENT_TERMS, control_terms=CONTROL_TERMS,
    frame_control_terms=FRAME_CONTROL_TERMS, refused_lines=[NAVIGATION_LINE, "(?i)" + CONTROL_LINE], line_repairs=LINE_REPAIRS,
    heading_end=HEADING_END, broken_fragments=BROKEN_FRAGMENTS, fragment_repairs=FRAGMENT_REPAIRS, document_repairs=DOCUMENT_REPAIRS,
    part_triggers=PART_TRIGGERS, review_item=REVIEW_ITEM, rule_code=RULE_CODE, rule_item=RULE_ITEM, stale_uncertainties=STALE_UNCERTAINTIES,
)
