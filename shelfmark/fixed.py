"""Word lists, concept pairs and routing rules that results depend on. A caller may give others of the same shape."""

#: Words of questions, which are dropped from queries of content search.
STOP_WORDS = ("如何", "怎么", "怎样", "为何", "为什么", "什么", "哪些", "哪里", "帮我", "请问", "一下", "能否", "吗", "我想", "我要", "想要", "需要")

#: Words that a "use when" clause may begin with and that are no part of a trigger.
CLAUSE_WORDS = (
    "the", "a", "an", "user", "users", "you", "your", "they", "someone",
    "want", "wants", "need", "needs", "ask", "asks", "asking", "require",
    "requires", "for", "to", "and", "or", "of", "when", "is", "are",
    "please", "help", "with", "into",
)

#: Concept pairs for querying across languages.
CONCEPTS = {
    "周报": ("report", "weekly"), "日报": ("report", "daily"),
    "报表": ("report", "dashboard"), "技能": ("skill",),
    "编排": ("orchestrate", "pipeline", "chain"), "串联": ("chain", "pipeline"),
    "检索": ("search", "retrieve"), "搜索": ("search",),
    "修复": ("fix", "repair"), "测试": ("test", "testing"),
    "审查": ("review", "audit"), "检查": ("check", "review"),
    "翻译": ("translate", "translation"), "文档": ("document", "doc"),
    "数据": ("data",), "图表": ("chart", "graph", "visualization"),
    "邮件": ("email", "mail"), "合同": ("contract",),
    "流程": ("flow", "process", "workflow"), "分析": ("analysis", "analyze"),
    "优化": ("optimize", "optimization"), "重构": ("refactor", "refactoring"),
    "清理": ("cleanup", "clean"), "安全": ("security", "vulnerability"),
    "部署": ("deploy", "deployment"), "开发": ("develop", "development", "coding"),
    "实现": ("implement", "implementation"), "功能": ("feature", "function"),
    "页面": ("page", "web", "frontend"), "接口": ("api", "interface"),
    "工具": ("tool",), "服务": ("service",), "应用": ("app", "application"),
    "系统": ("system",), "模块": ("module",), "脚本": ("script",),
    "配置": ("config", "configuration"), "监控": ("monitor", "alert"),
    "告警": ("alert", "alarm"), "日志": ("log", "logging"),
    "数据库": ("database", "db"), "缓存": ("cache", "caching"),
    "同步": ("sync", "synchronize"), "更新": ("update", "upgrade"),
    "导出": ("export",), "导入": ("import",), "解析": ("parse", "parser"),
    "生成": ("generate", "create"), "删除": ("delete", "remove"),
    "查询": ("query", "search", "find"), "统计": ("stats", "statistics"),
    "可视化": ("visualization", "chart"), "图谱": ("graph", "topology"),
    "诊断": ("diagnose", "debug", "troubleshoot"), "排错": ("debug", "troubleshoot"),
    "排查": ("diagnose", "troubleshoot", "investigate"),
    "报告": ("report", "summary"), "总结": ("summary", "conclusion"),
    "审批": ("approval", "review"), "卡控": ("gate", "check", "control"),
    "验证": ("validate", "verify", "test"), "校验": ("validate", "verify"),
    "转换": ("convert", "transform", "migration"),
    "自动化": ("automation", "automate", "auto"),
    "演示": ("demo", "presentation", "slides"),
    "幻灯片": ("slides", "ppt", "presentation"),
    "表格": ("table", "spreadsheet", "excel"),
    "图片": ("image", "picture", "photo"),
    "视频": ("video",), "音频": ("audio",), "文本": ("text", "content"),
}

#: Lifecycle stages, each a title and the query that finds what serves it; the coding stage also takes a task's own finds.
LIFECYCLE = (
    ("拆解规划", "需求分析 拆解规划 requirement analysis planning breakdown"),
    ("资料核查", "资料核查 文档查询 documentation lookup reference docs"),
    ("编码实现", "编码 功能开发 开发实现 feature development implementation coding develop"),
    ("测试验证", "测试验证 红绿回归 tdd testing validation test tests"),
    ("修错排查", "修错排查 诊断 debugging debug troubleshoot bug diagnose"),
    ("重构治理", "重构 治理 refactor 优化 optimizer"),
    ("清理瘦身", "清理 瘦身 冗余 deslop cleanup slop"),
    ("审查把关", "代码审查 评审把关 code review"),
    ("安全卡点", "安全审查 安全漏洞 卡点 owasp vulnerability"),
    ("归档交付", "归档 交付 文档 documentation delivery doc archive"),
)
CODING = "编码实现"

#: Words of process; a name of nothing else belongs to no domain.
PROCESS_WORDS = (
    "plan", "planning", "analysis", "requirement", "requirements",
    "doc", "docs", "documentation", "coding", "code", "develop",
    "development", "dev", "implementation", "implement", "test",
    "testing", "tests", "validation", "debug", "debugging",
    "troubleshoot", "refactor", "cleanup", "clean", "deslop",
    "review", "security", "audit", "archive", "delivery", "slop",
    "cleaner", "diagnose", "feature", "tdd", "interview",
    "workflow", "process", "gate", "lookup", "reference", "guide",
    "ai", "optimizer", "optimize", "optimization", "research", "deep",
)

#: A request for development names one of each.
ACTIONS = (
    "开发", "实现", "编写", "写一个", "做一个", "写个", "搞一个",
    "创建", "制作", "修复", "新增", "重构", "部署", "上线",
    "加一个", "添加", "build", "implement", "develop", "fix",
    "refactor", "deploy",
)
OBJECTS = (
    "技能", "功能", "命令", "页面", "接口", "服务", "工具",
    "脚本", "模块", "应用", "系统", "报表", "skill", "feature",
    "command", "tool", "module", "app",
)

#: Routing rules in order of priority: command and patterns. A word bound is meant where \b stands; one pattern that names another product is left out.
ROUTES = (
    ("platform_bridge", ("宿主.*不可达", "沙箱.*(拦|隔离|拦不住)", "工作区越界", "越界", "安全策略.*拦", "平台.*(数据库|API)", "清单.*落.*镜像", "镜像目录")),
    ("roots", ("0\\s*项", "扫不到", "没(有)?扫到", "为什么.*(没有|找不到|是0)", "找不到技能", "扫描根", "扫的是哪", "识别不到技能", "环境.*技能.*在")),
    ("import", ("导入.*(技能)?清单", "平台的技能清单", "粘贴.*清单", "注入.*提示词", "没有落盘", "沙箱.*技能", "手工.*导入")),
    ("clean", ("清理.*(产物|索引|缓存|文件)", "清空.*(产物|索引|缓存)", "恢复纯净", "打包前清理", "\\bclean\\b")),
    ("memory", ("活跃记忆", "记忆库", "纠偏.*(记录|日志|审计)", "查看记忆", "\\bmemory\\b")),
    ("profile", ("用户画像", "配置.*(扫描|根|目录)", "设置.*(扫描|根|目录)", "置顶.*技能", "排除.*技能", "全局指令", "查看配置", "修改配置", "\\bprofile\\b")),
    ("doctor", ("体检", "检查.*(技能|质量)", "有(没有)?.*问题", "坏(的)?描述", "健康")),
    ("audit", ("省(了)?多少", "压缩", "token.*(省|用|账|花|占|统计|审计)|省.*token", "提速", "量化", "节省", "体积")),
    ("bundle", ("上传", "打包", "boot", "分层", "L0|L1|L2", "网页", "制品", "发布")),
    ("export", ("导出", "转成.*(json|md|csv|txt|表格|excel)", "(json|md|csv|txt).*(格式|文件)", "markdown|md\\b")),
    ("add", ("加入索引", "添加.*技能", "把这个技能.*加", "未索引", "没(有)?索引")),
    ("update", ("增量", "新增.*(索引|技能)", "加了.*技能", "改了.*描述", "更新索引", "扫描.*新增", "新装.*技能")),
    ("index", ("重建", "重新(索引|生成|扫描|建)", "全量", "刷新索引", "重新整理")),
    ("content-find", ("答案在哪", "代码在(哪|第几行)", "哪行代码", "在哪个文件", "定义在哪", "找(出)?代码", "查(找)?正文", "正文检索", "搜代码")),
    ("detail", ("完整", "全文", "skill\\.md", "全部内容", "原文")),
    ("explain", ("怎么用", "怎么触发", "使用建议", "怎么调用", "怎么起效", "详细.*用法", "介绍.*技能")),
    ("related", ("相似", "类似", "相关.*技能", "还有.*技能")),
    ("help", ("哪些命令", "什么命令", "命令(一览|列表|有哪些)", "帮助", "\\bhelp\\b", "用法说明", "支持哪些操作", "(索引器|这个技能|这个工具|本技能|它).*(干嘛|干什么|做什么|是什么)")),
    ("pipeline", ("串联", "流水线", "编排", "端到端", "从需求到", "生命周期", "开发需求", "完整流程", "完整开发", "开发一个", "重构.*项目", "排查.*并.*(修复|解决)", "从.*到.*(上线|发布|审查|交付)", "从规划到", "全流程", "pipeline", "chain", "开发.*(需求|系统|模块|功能|接口)", "实现.*(需求|系统|模块|功能|接口)")),
    ("chat", ("使用\\s*[「【]?[\\w-]+[」】]?\\s*技能", "调用\\s*[「【]?[\\w-]+[」】]?\\s*技能", "@[\\w-]+", "跑一下.*技能", "流程(是|怎么走|如何|步骤)", "后续.*流程", "怎么(处理|操作|流转|执行)", "业务.*怎么", "合同.*流程", "操作步骤", "如何操作", "如何处理", "怎么做", "帮我查", "问答", "状态机")),
    ("search", ("哪个技能", "该用.*技能", "用哪个", "适合.*技能", "挑.*技能", "检索", "搜索", "搜(一下|个|代码|技能)", "匹配.*技能", "找.*技能", "哪个工具", "帮我(把|将|做|实现|处理|搞定|完成)", "用什么(技能|工具)", "我要(做|实现)")),
    ("list", ("有哪些", "列出", "全部技能", "所有技能", "技能清单", "清单", "盘点", "多少个", "多少.*技能")),
    ("stats", ("统计", "分布", "来源", "多少项")),
    ("catalog", ("总览", "生成文档", "文档版", "网页展示")),
)
PIPELINE_CUES = ("开发", "实现", "做个", "写个", "排查", "修复", "重构", "端到端")
QUESTION_CUES = ("？", "?", "吗", "怎么", "如何", "是什么", "哪", "为什么", "我想", "我要", "想要", "需要")
DEFAULT_ROUTE = "list"
