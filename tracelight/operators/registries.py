"""Ordered token tables. Order is priority; the first match wins unless an operator says otherwise.

Every entry must equal what published detectors use for equal results, so these are plain data.
"""

from __future__ import annotations

BYTEDANCE = "ByteDance (Doubao / Jimeng / Volcano Engine)"
#: (issuer token, organisation, platform, needle, issues SynthID, SynthID needs a watermark action, asserts AI)
ISSUERS = (
    ("Microsoft", "Microsoft", "Microsoft (Bing Image Creator / Designer)", "Microsoft", False, False, False),
    ("Adobe", "Adobe", "Adobe Firefly", "Adobe", False, False, False),
    ("OpenAI", "OpenAI", "OpenAI (ChatGPT / gpt-image / DALL-E / Sora)", "OpenAI", True, True, False),
    ("Google", "Google LLC", "Google (Gemini / Imagen)", "Google", True, False, False),
    ("Stability AI", "Stability AI", "Stability AI (Stable Image / DreamStudio)", "Stability AI", False, False, False),
    ("Black Forest Labs", "Black Forest Labs", "Black Forest Labs (FLUX)", "Black Forest Labs", False, False, False),
    ("volcengine", "ByteDance (Volcano Engine)", BYTEDANCE, "ByteDance", False, False, False),
    ("北京火山引擎科技有限公司", "ByteDance (Volcano Engine)", BYTEDANCE, "ByteDance", False, False, False),
    ("Byteplus", "BytePlus (ByteDance)", BYTEDANCE, "ByteDance", False, False, False),
    ("Dreamina", "ByteDance (Dreamina)", BYTEDANCE, "ByteDance", False, False, True),
    ("Canva", "Canva", "Canva (Magic Media)", "Canva", False, False, False),
    ("Eleven Labs", "ElevenLabs", "ElevenLabs", "ElevenLabs", False, False, False),
    ("fal-ai", "fal.ai", "fal.ai", "fal.ai", False, False, True),
    ("Bria", "Bria Artificial Intelligence", "Bria AI", "Bria", False, False, True),
    ("Truepic", "Truepic", None, None, False, False, False),
)
ISSUER_NAMES = tuple((x[0], x[1]) for x in ISSUERS)
ISSUER_PLATFORMS = tuple((x[3], x[2]) for x in ISSUERS if x[2])
IDENTITY_AI = tuple(x[1] for x in ISSUERS if x[6])

CLAIM_GENERATORS = (
    ("adobe_firefly", "Adobe Firefly"),
    ("firefly", "Adobe Firefly"),
    ("dreamina", BYTEDANCE),
    ("higgsfield ai", "Higgsfield AI"),
    ("topaz labs image api", "Topaz Labs"),
    ("tiktok ad creative toolbox", "TikTok Ad Creative Toolbox"),
)
AI_TOOLS = (
    ("GPT-4o", "GPT-4o"),
    ("ChatGPT", "ChatGPT"),
    ("Sora", "Sora"),
    ("DALL-E", "DALL-E"),
    ("DALL", "DALL-E"),
    ("Imagen", "Imagen"),
    ("Firefly", "Firefly"),
    ("Dreamina", "Dreamina"),
)
SOFT_BINDINGS = (
    ("com.adobe.trustmark", "Adobe TrustMark"),
    ("com.adobe.icn", "Adobe (content fingerprint)"),
    ("com.digimarc", "Digimarc"),
    ("com.imatag.lamark", "Imatag (Lamark)"),
    ("ai.steg", "Steg.AI"),
    ("com.microsoft.invismark", "Microsoft InvisMark"),
    ("com.microsoft.wavmark", "Microsoft WavMark"),
    ("com.verimatrix", "Verimatrix"),
    ("com.nagra.nexguard", "NAGRA NexGuard"),
    ("com.aiwatermark", "AIWatermark (Meta PixelSeal)"),
    ("ai.trufo", "Trufo"),
    ("app.overlai", "Overlai"),
    ("com.markany", "MarkAny"),
    ("com.mentaport", "Mentaport"),
    ("es.lumatrace", "LumaTrace"),
    ("ai.verda", "VerdaAI"),
    ("ai.contentlens", "ContentLens"),
    ("io.iscc", "ISCC (content code)"),
)
CAMERAS = (
    ("lc_c2pa", "Leica (camera, C2PA capture)"),
    ("Leica Camera", "Leica (camera, C2PA capture)"),
    ("NIKON", "Nikon (camera, C2PA capture)"),
    ("Pixel Camera", "Google Pixel (camera, C2PA capture)"),
    ("sony.sig", "Sony (camera, C2PA capture)"),
    ("sony.cert", "Sony (camera, C2PA capture)"),
    ("Truepic_Lens", "Truepic Lens (verified capture)"),
)
SIGNERS = (("Samsung Galaxy", "Samsung Galaxy (C2PA)"), ("com.asus.gallery", "ASUS Gallery (C2PA signer)"))
CLOUD_STORES = (("cai-manifests.adobe.com", "Adobe Content Authenticity"),)
VENDORS = (
    ("gpt-image", "OpenAI"), ("dall", "OpenAI"), ("sora", "OpenAI"), ("openai", "OpenAI"),
    ("gemini", "Google"), ("imagen", "Google"), ("nano banana", "Google"), ("google", "Google"),
    ("firefly", "Adobe"), ("adobe", "Adobe"),
    ("bing", "Microsoft"), ("designer", "Microsoft"), ("microsoft", "Microsoft"),
    ("stability", "Stability AI"), ("stable diffusion", "Stability AI"), ("sdxl", "Stability AI"),
    ("ideogram", "Ideogram"), ("grok", "xAI"), ("aurora", "xAI"), ("xai", "xAI"),
    ("bytedance", "ByteDance"), ("doubao", "ByteDance"), ("jimeng", "ByteDance"), ("dreamina", "ByteDance"),
    ("volcengine", "ByteDance"), ("volcano engine", "ByteDance"),
    ("canva", "Canva"), ("elevenlabs", "ElevenLabs"), ("eleven labs", "ElevenLabs"),
    ("black forest", "Black Forest Labs"), ("fal-ai", "fal.ai"), ("bria", "Bria"), ("apple photos clean up", "Apple"),
)
#: Signal families of watermark descriptions.
FAMILIES = (
    ("synthid", ("synthid",)),
    ("visible_sparkle", ("sparkle",)),
    ("visible_doubao", ("豆包", "doubao")),
    ("visible_jimeng", ("即梦", "jimeng")),
    ("visible_samsung", ("galaxy ai", "generati dall")),
    ("aigc_tc260", ("aigc", "tc260")),
    ("iptc", ("iptc", "digitalsourcetype", "made with ai", "made-with-ai")),
    ("c2pa", ("c2pa", "content credentials")),
    ("trustmark", ("trustmark",)),
    ("open_invisible", ("open invisible", "dwt", "stable diffusion xl")),
    ("xai_signature", ("xai", "grok signature")),
    ("exif_generator", ("exif", "software tag", "png text")),
)
C2PA_UUID = bytes.fromhex("d8fec3d61b0e483c92975828877ec481")
GENERATED_MARKERS = ("trainedAlgorithmicMedia", "TrainedAlgorithmicMedia")
ENHANCED_MARKERS = ("compositeWithTrainedAlgorithmicMedia", "compositeSynthetic")
IPTC_MARKERS = ("trainedAlgorithmicMedia", "compositeSynthetic", "compositeWithTrainedAlgorithmicMedia")
IPTC_FIELDS = ("AISystemUsed", "AISystemVersionUsed", "AIPromptInformation", "AIPromptWriterName")
AIGC_MARKERS = ("tc260.org.cn/ns/AIGC", "TC260:AIGC")
LOCAL_KEYS = ("comfyui", "dream", "invokeai_metadata", "negative_prompt", "parameters", "prompt", "workflow")
#: Metadata keys of generators (lower case), and parts of keys that name one.
AI_KEYS = (
    "ai_metadata", "c2pa", "c2pa_chunk", "comfyui", "dream", "generation_data", "invokeai_metadata", "negative_prompt", "parameters", "prompt", "sd-metadata",
    "sd:cfg_scale", "sd:model_hash", "sd:negative_prompt", "sd:prompt", "sd:sampler", "sd:seed", "sd:steps", "software", "workflow",
)
AI_KEY_PARTS = ("stable_diffusion", "comfyui", "automatic1111", "invokeai", "midjourney", "dall-e", "dalle", "imagen", "synthid", "google_ai", "openai", "c2pa")
GENERIC_AIGC = "China AIGC (TC260)"

#: (mark, product, label regime, platform tokens, signals that confirm it, producer codes)
MARKS = (
    ("gemini", "gemini", None, ("google", "gemini"), (), ()),
    ("doubao", "doubao", "tc260", (), ("aigc",), ("91110102MACQD9K640", "doubao")),
    ("jimeng", "jimeng", "tc260", (), ("aigc",), ("9144030008867405X2",)),
    ("qwen", "qwen", "tc260", (), ("aigc",), ("91440101MA9Y9T4H7A",)),
    ("kling", "kling", "tc260", (), ("aigc",), ("91110108335469089C",)),
    ("yuanbao", "yuanbao", "tc260", (), ("aigc",), ("91440300708461136T",)),
    ("samsung", "samsung", None, (), ("samsung_genai",), ()),
    ("runninghub", "runninghub", "tc260", (), ("aigc",), ("91340100MAEB4N8H76", "RunningHub")),
    ("baidu", "baidu", "tc260", (), ("aigc",), ("91110000802100433B",)),
    ("liblib", "liblib", "tc260", (), ("aigc",), ("91110105MACJ6K1C8A",)),
    ("jimeng_pill", "jimeng", "tc260", (), (), ()),
)
PRODUCT_OF = {m[0]: m[1] for m in MARKS}
PRODUCER_MARKS = {code: m[0] for m in MARKS for code in m[5]}
FALLBACK_MARKS = ("doubao", "jimeng")
NO_WITNESS = ("jimeng_pill",)

#: mark -> weak floor, weak floor with provenance, strong floor, transition floor, frames, carries without provenance, anchor IoU, accepts provenance
VIDEO_POLICIES = (
    ("sora", 0.60, 0.58, 0.65, 0.45, 5, False, None, True),
    ("veo", 0.50, 0.45, 0.55, 0.35, 12, True, None, True),
    ("seedance", 0.38, None, 0.43, 0.30, 12, True, 0.80, True),
    ("dola", 0.50, 0.48, 0.52, 0.40, 12, True, 0.80, True),
    ("hailuo", 0.30, None, 0.34, 0.28, 12, True, 0.80, False),
    ("kling", 0.20, None, 0.24, 0.30, 12, True, 0.80, False),
)
STABLE_GAP, STABLE_IOU = 3, 0.55
