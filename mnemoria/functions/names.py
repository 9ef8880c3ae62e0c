"""Word lists of entity extraction. Fixed values of the specification, in their order.

Names of particular products, tools and files are left out of GARBAGE; a caller passes its own.
"""

#: Single-character surnames.
SURNAMES = (
    "王李张刘陈杨赵黄周吴徐孙胡朱郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾萧田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚"
    "卢姜崔钟谭陆汪范金石廖贾夏韦方白邹孟熊秦邱江尹薛阎段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴莫孔向汤温庞殷章葛管甘卞冉蓝殷习"
)
#: Verbs that follow a person's name.
PERSON_VERBS = ["说", "问", "答", "表示", "回答", "提出", "决定", "认为", "指出", "解释", "告诉", "写道", "想", "觉得", "知道", "喜欢", "讨厌", "确认", "提醒", "分享", "建议", "同意", "反对"]
TITLES = ["医生", "大夫", "老师", "先生", "女士", "同志", "经理", "主任", "教授", "院长", "局长"]
#: Words that are never an entity.
STOP_WORDS = [
    "的", "了", "着", "过", "得", "地", "吗", "吧", "呢", "啊", "喔", "耶", "我", "你", "妳", "他", "她", "它", "您", "咱",
    "我们", "你们", "妳们", "他们", "她们", "它们", "咱们", "自己", "大家", "有人", "没人", "今天", "明天", "昨天", "前天", "后天", "今年", "明年", "去年",
    "早上", "下午", "晚上", "中午", "凌晨", "现在", "刚才", "刚刚", "等等", "等下", "待会", "最近", "以前", "之前", "之后", "以后", "后来",
    "什么", "为什么", "怎么", "怎样", "哪里", "哪个", "这个", "那个", "这里", "那里", "这些", "那些", "这样", "那样",
    "但是", "可是", "然后", "所以", "因为", "如果", "虽然", "而且", "或者", "或是", "还是", "不过", "只是", "不只", "既然", "不然", "否则", "此外", "另外",
    "很", "非常", "相当", "真的", "确实", "当然", "其实", "已经", "正在", "即将", "将要", "刚好", "恰好", "可能", "也许", "或许", "大概", "应该", "必须", "一定",
    "完成", "执行", "进行", "开始", "结束", "继续", "停止", "完毕", "没有", "有点", "有些", "一些", "许多", "很多",
    "问题", "答案", "原因", "结果", "情况", "状况", "主要", "重要", "基本", "简单", "复杂", "特别",
    "谢谢", "感谢", "对不起", "不好意思", "请问", "欢迎", "再见", "你好", "您好", "哈喽", "拜拜",
]
#: States, counters and calls that are never an entity.
GARBAGE = [
    "normal", "DB", "KG", "3", "5", "10", "OK", "N/A", "ingest_count", "search_count", "flush_count", "l1_count", "l2_count", "system_health", "system_stats",
    "mental_models_query", "memory_search", "memory_context", "memory_ingest", "kg_query", "verbatim_recall", "consolidate_trigger", "memory_compress",
    "pipeline_run", "reflect_trigger", "list_prompts", "get_prompt", "list_resources", "read_resource", "memory.provider", "sync_turn", "prefetch",
    "L1提取器", "L2场景组织", "引擎初始化", "MCP子进程", "DeepSeek", "ARK", "Gateway", "Windows",
]
#: English words that are no names.
GENERIC = [
    "error", "window", "windows", "install", "installer", "dll", "utf", "utf8", "user", "profile", "system", "file", "config", "api", "app", "tool", "tools",
    "model", "models", "framework", "platform", "software", "protocol", "key", "keys", "default", "true", "false", "none", "null", "test", "tests",
    "fix", "fixed", "bug", "bugs", "debug", "code", "codes", "data", "info", "message", "messages", "memory", "memories", "server", "client",
    "service", "services", "thread", "threads", "pool", "process", "processes", "exe", "py", "pyinstaller",
]
#: What stands before a name and is no part of it; the second list stays before products.
NOISE_PREFIXES = [
    "用户", "我们", "我", "正在", "已经", "开始", "继续", "需要", "可以", "希望", "评估", "测试", "进行", "使用", "通过", "完成", "负责",
    "参与了", "参加了", "参与", "参加", "加入", "关于", "对于", "因为", "所以", "然后", "但是", "以及", "还有", "包括", "根据", "针对",
    "表示", "认为", "建议", "推荐", "喜欢", "正在使用", "正在学习", "讨论", "商量", "今天", "明天", "昨天", "去", "来", "开会",
    "说", "讲", "谈", "聊", "强调", "指出", "提到", "提及", "开会讨论", "发布", "推出", "上线", "合作", "签署", "达成", "宣布",
    "准备", "打算", "计划", "考虑", "看", "看看", "最近", "前", "后", "学习", "研究", "开发", "建设", "管理", "运营", "服务", "提供",
    "支持", "实现", "打造", "构建", "推动", "促进", "加强", "与", "和", "及", "向", "为", "给", "对", "把", "从", "在", "跟", "同",
    "还有", "也是", "就是", "作为", "成为", "属于", "位于", "这个", "那个", "这些", "那些", "某个", "一些", "每个",
]
PRODUCT_PREFIXES = ["评估", "测试", "管理", "开发", "服务", "支持", "使用", "研究", "建设", "运营", "提供", "实现", "打造", "学习", "分析", "监控", "预测", "营销", "客户", "智能", "数字"]
#: Endings that a cleaned name keeps, by type.
TYPE_SUFFIXES = {
    "person": ["医生", "大夫", "老师", "先生", "女士", "同志"],
    "org": ["有限公司", "研究院", "基金会", "中心", "公司", "集团", "医院", "大学", "学院", "协会", "局", "部", "委", "办", "院", "社"],
    "location": ["省", "市", "县", "区", "镇", "乡", "村", "路", "街", "大道", "桥", "山", "河", "湖"],
    "product": ["系统", "平台", "软件", "工具", "协议", "模型", "框架", "方案", "APP", "API"],
}
#: Words that a person's pattern can meet and that are none.
NO_PERSONS = ["方案", "系统", "平台", "模型", "框架", "引擎", "管线", "器具", "工具"]
#: What follows a name in speech, and in action; pronouns.
DIALOGUE = [":", "：", "说", "问", "答", "表示", "认为", "指出", "回答", "解释", "告诉", "写道", "想", "觉得", "知道", "喜欢", "确认", "提醒", "分享", "建议", "同意", "反对", "决定", "提出"]
ACTIONS = ["做了", "用了", "完成了", "参加了", "去过", "用过", "吃过", "看过", "听过", "负责", "管理", "处理", "开发", "设计", "编写", "创建", "修改", "修复", "测试", "部署", "发布"]
PRONOUNS = ["他", "她", "它", "其"]
#: Endings of organisations, places and products in the patterns.
ORG_ENDS = "局(?!长)|公司|医院|集团|部|委|办|院|中心|社|协会|基金会|大学|学院|研究院"
LOCATION_ENDS = "省|市|县|区|镇|乡|村|路|街|大道|桥|山|河|湖|江|海"
PRODUCT_ENDS = "系统|平台|软件|APP|工具|API|协议|模型|框架|方案|管线|引擎"
HAN = "[一-鿿]"
LATIN_PERSON = "[A-Z][a-z]+(?:[ \t\n]+[A-Z][a-z]+)*"
LATIN_ORG = "[A-Z]{2,}(?:-[A-Z]+)*"
#: Patterns in order, with the type that they find; those of Han letters first.
HAN_PATTERNS = [
    (f"[{SURNAMES}]{HAN}{{1,2}}(?:{'|'.join(PERSON_VERBS)})", "person"),
    (f"[{SURNAMES}]{HAN}{{1,2}}(?![了是案]|(?<!也){HAN})", "person"),
    (f"(?<!{HAN}){HAN}{{1,4}}(?:{'|'.join(TITLES)})", "person"),
    (f"(?<![了的是在跟与])(?<!{HAN}){HAN}{{1,8}}(?:{ORG_ENDS})", "org"),
    (f"(?<![了的是在跟与])(?<!{HAN}){HAN}{{1,8}}(?:{LOCATION_ENDS})", "location"),
    (f"(?<![是说了和跟与在])(?<!{HAN}{{3}}){HAN}{{1,4}}(?:{PRODUCT_ENDS})", "product"),
]
LATIN_PATTERNS = [(LATIN_PERSON, "person"), (LATIN_ORG, "org")]
