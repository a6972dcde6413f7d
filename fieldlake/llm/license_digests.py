"""Digests of the canonical forms of long licence texts, by SPDX identifier.

Each text is there with and without its title, and with and without its appendix
(terms to apply it, exhibit A); Apache-2.0 also with a filled-in appendix. Made
from the copies in /usr/share/common-licenses by license_scan's functions, and to
be made anew whenever REWRITES change.
"""

DIGESTS = (
    ("Apache-2.0", "161b8bf8e6b95b07432fce16883d0306f0135aa4b5603e23584ae7fdabcdf25e"),
    ("Apache-2.0", "6b44f1d7bdfe582e8b934acbe80c2a3827fdbaa892eafdae141d6608c7895895"),
    ("Apache-2.0", "74956aa5491c3bcd5707e5f8c68baae68f8fdad9cc6cc7c0d787192b64b19863"),
    ("Apache-2.0", "b3cc459fbb25eb31fe5f9358e56eacc247196cd4c196575b2936641dee290e46"),
    ("Apache-2.0", "be882f012c4ee11a034b73a1e08f4d4ebfff95a9e2055e6e028b54a059719748"),
    ("Apache-2.0", "c119805271b8f75a71e8e8209a9f11feed2868a78a037941297e054e084ebddd"),
    ("Apache-2.0", "ea7027d040966ecc4e6fb38916005e9166f29a67aef68bc59ed8400e4c0457e8"),
    ("Apache-2.0", "fafec54ba60d57918882aa1139b57d41076a35a2c7a28b0e91a49fb1ede0f7e2"),
    ("CC0-1.0", "95ebf30e4e7b3207347a0c69d79986748680945916965d18147efef74ee779d5"),
    ("CC0-1.0", "fd2e8b2f77d647712261900a8363db14939f284a8668bc4f2983a0f5b3ca278e"),
    ("GPL-1.0-only", "194415cdb0eb23fd61720752fe3409b304a8ee0f1566c90970babf24307bb94e"),
    ("GPL-1.0-only", "2545391904fdd8c5bdff6d3ee872f017fb46cdc0004a6c72046b2bfca60bb466"),
    ("GPL-1.0-only", "2c4b87a2d6aacb3ebfbfc1d3b76b65014eaa17bf1189ff96ff23e2a6bab8b294"),
    ("GPL-1.0-only", "3edf3894fcb061b26368a469f84e6a01c43da602892ff5aecfc92523e4ccb323"),
    ("GPL-1.0-only", "7c44b8eb865fe966a40802ecc4db94bbcc652d5bee2730d6bfa72acceae928ce"),
    ("GPL-1.0-only", "d2568d9768e1931a5e2699af1156814924440f81fc0ed21c5db867d47dc6e074"),
    ("GPL-2.0-only", "4bab8641e512714c0425880567a1470dd60daf08e483e8ea66f8b3f9dd17535f"),
    ("GPL-2.0-only", "51e7afc1e69abbd2a3978094d49e11985d7c1843c56991d841c5c6f642bd915b"),
    ("GPL-2.0-only", "6d5ef54119a9b65cd85b06f6c92cc3f4367e5a737b6c5a9a45f76a11212a9012"),
    ("GPL-2.0-only", "9f43302e5122a0f096fe401cd93f5de20e46857f7eab424ca61a9250e05b41de"),
    ("GPL-2.0-only", "ab76223432962441cb7e565aea346405b1ee7a2e8b389b80db53494e8371f6d1"),
    ("GPL-2.0-only", "f13bb023b8ed6c0a0db55317b7b77c3ba32c7989dd4b2e1d61e757e3b657e198"),
    ("GPL-3.0-only", "0a5c7b9bcbd29b5ea40b4931d0f7c5307877e0ccee97f4cd12ca5a7cc4b87d4b"),
    ("GPL-3.0-only", "0ddeb0c4d3d3c859eb33a0766e7c300509ff43f002f728c0d1e6676c46ec2716"),
    ("GPL-3.0-only", "5f7440a9f294f934a1fe6718bac859d8ee674a30554460b3cd84ec4839eab018"),
    ("GPL-3.0-only", "613c9b026d0896b66cf857c95a14e4b190b643f22074c72c80c186cfbba73ee8"),
    ("GPL-3.0-only", "d4da548e1ec33a6bde199a3e7e2f0ca6cb2e51a9aaa8bdceab4d238aadc7a76f"),
    ("GPL-3.0-only", "ecdefe7f53b37443e441bd91d03dd29222297073a1571c441f55afa7376bca82"),
    ("LGPL-2.0-only", "198349c6fdf54bf43054aa8f2995661d230cf7c02cb56b9a5a42025957f6f3bd"),
    ("LGPL-2.0-only", "29ac81adef146704b174b798494d0d42eef23ca231915f66c81f934c669571a5"),
    ("LGPL-2.0-only", "3e06601a35c661567a9587d18a8e9e3851650dcc073c4c3b02e2cf0b1d4ed6f8"),
    ("LGPL-2.0-only", "5906d1a185811410f59190799d48a7230668272ac111eb4ef6dcd629cb0cd43e"),
    ("LGPL-2.0-only", "ac2278c4abcd506dda8b9b1180ad6de76599efab49edc982729fa6130d0722e4"),
    ("LGPL-2.0-only", "ec2b7285ec3bb36596620f10c82f53ef8c397f0cb847872c5e8bf29ccac50e7d"),
    ("LGPL-2.1-only", "02a354cc8fc47763238143a0d3549ce3c6f5f24edb70633e6ae498915638baff"),
    ("LGPL-2.1-only", "2593495f083241b2bebbec7550845b14acb5292e70e71473b9ae7cc8990c0580"),
    ("LGPL-2.1-only", "3acf83a1d5d2121db3409872cc6d739d5ac066044afde4a73c445af48de18456"),
    ("LGPL-2.1-only", "7c441b0cae57db9c71bb9e3e93c46e74ec58b68afe8c86c3d3034ec4f597ed53"),
    ("LGPL-2.1-only", "a367d6b9e763a3ade87f182ded26c6c8fb5d391816ae5ffe115f6d362f791a56"),
    ("LGPL-2.1-only", "f6c1bf049308fe7595bd3efebbd60d92fe42681c377767e87221eebe662f886d"),
    ("LGPL-3.0-only", "b3bbcc8ad04219f26fde934ef2a84e206fb5480950f26e08aa0f1f780741c958"),
    ("LGPL-3.0-only", "e25878ab18361c2fdd4d118a94a3de1b887b321a2efae16f9d32af32eb274090"),
    ("MPL-1.1", "26ff581b9de31b1068754c457e40747421bbf5a008c96c927a82faec10ee76fd"),
    ("MPL-1.1", "c2fa9ad149e3a8aca36c8d04eff537ad0521fec2e7a89d5397d99bb7643e6ce4"),
    ("MPL-1.1", "dd8fc6bfe9912907a48d34e641cb9f6518a21aabed8f7767e52d24d1265adf1b"),
    ("MPL-1.1", "e8f5f4555e072395962283a8de7e8857d21ef8c1913230c269854152f4252517"),
    ("MPL-2.0", "19b61ee96ac7a4973ddcde09c3eba7e4b4fc4aae5599456f03d88ab51eed6e32"),
    ("MPL-2.0", "58e6bfe28e03be0c6390febf1ae0bd6a498fcd3c318efea08c3c17fe8d5bf663"),
    ("MPL-2.0", "6c6e4b9d340c521c5cda6f985ba872c0ca29c3b8959b856feca6b234da690d0e"),
    ("MPL-2.0", "f84b538497cbc5f36eda6ff940f55c622ed5239402b894643431246483ee17f0"),
)
